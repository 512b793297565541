"""Files of the operators' own formats, written and read by tasks through a URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, parts) -> str:
    """Write byte strings to ``folder/name`` and return its URI.

    The file appears under its final name only when complete, and the name holds a fresh id, so
    a task that is lost and run again neither breaks a file nor shares one.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{uuid.uuid4().hex[:12]}-{name}"
    with system.open_output_stream(f"{path}/.{own}", compression=None) as out:
        for part in parts:
            out.write(part)
    system.move(f"{path}/.{own}", f"{path}/{own}")
    return f"{folder.rstrip('/')}/{own}"


def open_file(uri: str):
    """Random-access input of a file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
