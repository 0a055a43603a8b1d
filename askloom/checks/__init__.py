"""The registered queries and the SQL each one is compared with."""

from askloom.checks import (  # noqa: F401  (each module registers its queries)
    collection_checks,
    context_checks,
    inference_checks,
    reply_checks,
    scalar_checks,
    session_checks,
    stream_checks,
    text_checks,
    toolcall_checks,
    vector_checks,
)
from askloom.checks.registry import CHECKS

__all__ = ["CHECKS"]
