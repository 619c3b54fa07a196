"""Binary files in the folder that all executors share: see ``cairnlog.plans.files``."""

from __future__ import annotations

from cairnlog.plans.files import attempt_name, new_folder, read_bytes, write_bytes

__all__ = ["attempt_name", "new_folder", "read_bytes", "write_bytes"]
