"""Helpers of several test files."""

from __future__ import annotations

import zipfile


def make_zip(path, members: dict[str, bytes]) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return str(path)
