"""Output folders on the driver."""

from __future__ import annotations

import zipfile
from pathlib import Path


def output_folder(path: str) -> Path:
    """The folder, made where it is missing; a file in its place is an error."""
    folder = Path(path)
    if folder.exists() and not folder.is_dir():
        raise ValueError(f"{path} is a file, not a folder")
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def archive(folder: str, target: str) -> list[str]:
    """A ZIP of all files below the folder, by name."""
    root = Path(folder)
    names = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and p.resolve() != Path(target).resolve())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(root / n, n)
    return names
