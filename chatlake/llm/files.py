"""Files that tasks write to, or read from, the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


@contextmanager
def committed(url: str):
    """A stream to url, which appears whole or not at all: a task that is lost or run twice leaves no half file."""
    system, path = opened(url)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


def reader(url: str):
    system, path = opened(url)
    return system.open_input_file(path)
