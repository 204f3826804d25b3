"""What a Python worker keeps from task to task.

A function that is sent by value brings its own copy of its module's globals to every task, so a
global of this package is new in each. What is dear to build (tokenizers, tables) stands in a
module of its own name that no function carries along.
"""

from __future__ import annotations

import sys
import types

NAME = "roadframes_kept_by_the_worker"


def kept() -> dict:
    """The process's table of kept objects."""
    module = sys.modules.setdefault(NAME, types.ModuleType(NAME))
    return module.__dict__.setdefault("kept", {})
