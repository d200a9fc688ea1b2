"""Keys under which signals and results are cached, from the parameters that made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import datetime


def session_stamp(now: datetime) -> str:
    """Session name of a run; later runs sort after earlier ones."""
    return now.strftime("%Y_%m_%d-%H%M%S")


def result_key(kind: str, params: Mapping[str, object]) -> str:
    """The kind of a result and a digest of its parameters, in whatever order they are given.

    Equal parameters give equal keys, and keys of one kind share its name as their prefix.
    """
    text = json.dumps(dict(params), sort_keys=True, default=list, separators=(",", ":"))
    return f"{kind}-{hashlib.sha256(text.encode()).hexdigest()[:20]}"
