"""Files in the shared folder, written and read inside tasks through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class Replaced:
    """A file that appears under its name only when it is complete; a second attempt of a task replaces the first."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str) -> None:
        system.create_dir(folder, recursive=True)
        self.system, self.name = system, f"{folder}/{name}"
        self.temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        # A file there is replaced by the move: attempts write the same bytes, and none leaves the name without a file.
        self.system.move(self.temporary, self.name)
