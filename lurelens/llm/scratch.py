"""Tables written between jobs in the folder that driver and executors share."""

from __future__ import annotations

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
