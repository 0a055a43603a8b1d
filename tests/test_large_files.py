"""Files read in splits of any size give the chunks of the whole file."""

import pytest
from conftest import rows

from askloom.sources.documents import chunk, read_documents
from askloom.sources.large_files import large_file_chunks

BYTES = "spark.sql.files.maxPartitionBytes"


TEXTS = [
    b"", b"\n\n\n# kept\n\n# gone\n\nb", b"a\r\n\r\n\r\nb\r\rc\n\r\nd", b"\n# kept\n\n\n\n\n# also", "é\n\n\n\n\n\n\n\né\nx\n\n".encode(),
]


@pytest.mark.parametrize("size", [9, 1 << 20])
def test_chunks_do_not_depend_on_the_splits(spark, tmp_path, size):
    for i, data in enumerate(TEXTS):
        (tmp_path / f"{i:02}.txt").write_bytes(data)
    want = rows(chunk(read_documents(spark, str(tmp_path))))
    before = spark.conf.get(BYTES), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(BYTES, str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cut = spark.read.text(str(tmp_path))
        got = large_file_chunks(spark, str(tmp_path))
    finally:
        spark.conf.set(BYTES, before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert rows(got) == want and len(want) == 10
    assert cut.columns == ["value"]
