"""Files of a shared folder for Python data sources, which run in driver and workers alike: local paths and the stores that Arrow knows."""

from __future__ import annotations

import re

import pyarrow.fs


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Spark writes local paths as ``file:/x`` and S3 as ``s3a:``."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", path))
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"^\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)


def sizes(folder: str, suffix: str) -> dict[str, int]:
    """Size of each file directly below a folder whose name ends in ``suffix``, by name, in order. Spark's own hidden files are left out."""
    system, at = opened(folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_"))}
