"""Writing files to the shared folder from tasks, so that a task that runs twice does no harm."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def make(folder: str) -> None:
    at, path = opened(folder)
    at.create_dir(path, recursive=True)


class Draft:
    """A file that is written under a name of its own and moved into place when it is whole: others never see half of it."""

    def __init__(self, folder: str, name: str):
        self.at, path = opened(folder)
        self.name, self.draft, self.size = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}", 0
        self.out = self.at.open_output_stream(self.draft, compression=None)

    def write(self, part: bytes) -> None:
        self.out.write(part)
        self.size += len(part)

    def finish(self) -> None:
        self.out.close()
        self.at.move(self.draft, self.name)


def put(folder: str, name: str, parts: list[bytes]) -> None:
    made = Draft(folder, name)
    for part in parts:
        made.write(part)
    made.finish()


def get(folder: str, name: str, begin: int = 0, length: int | None = None) -> bytes:
    at, path = opened(folder)
    with at.open_input_file(f"{path}/{name}") as f:
        f.seek(begin)
        return f.read() if length is None else f.read(length)
