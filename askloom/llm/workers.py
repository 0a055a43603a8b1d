"""State that lives as long as a Python worker, such as loaded vocabularies.

Task functions travel by value, so their module globals start afresh in every task.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

_HOME = "_task_state_of_this_worker"


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def only(name: Hashable, version: Hashable, make: Callable[[], Any]) -> Any:
    """Like ``kept``, but of each name only the version asked for last is held."""
    held = kept(("only", name), dict)
    if version not in held:
        held.clear()
        held[version] = make()
    return held[version]
