"""Files in the shared folder, as Python tasks reach them."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path in it."""
    if "://" not in uri and not uri.startswith("/"):
        uri = re.sub(r"^file:/*", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed(store: fs.FileSystem, folder: str, name: str) -> Iterator:
    """A stream to a temporary name, which takes the place of ``name`` once it is whole.

    A task that is run again, or twice at once, writes the same bytes under
    another temporary name, so that either may win.
    """
    temporary = f"{folder}/_temporary-{name}-{uuid.uuid4().hex}"
    stream = store.open_output_stream(temporary, compression=None)
    try:
        yield stream
    except BaseException:
        stream.close()
        with contextlib.suppress(OSError):
            store.delete_file(temporary)
        raise
    stream.close()
    store.move(temporary, f"{folder}/{name}")
