"""Files of arrays in any store that Arrow reaches, and versions of written folders.

A folder that a sink wrote holds files under names of their own and a manifest of those that count, `_manifests/<version>.parquet`; the
file `_current` names the manifest. A write adds files first and changes `_current` last, so a reader sees the old folder or the new one,
and a failed or repeated task leaves nothing that anybody reads. `vacuum` deletes what the manifest in force doesn't name.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

CURRENT = "_current"


@dataclass
class Store:
    """A folder in a file system."""

    uri: str

    def __post_init__(self):
        self.files, self.root = fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("/") else posixpath.abspath(self.uri))

    def at(self, name: str) -> str:
        return posixpath.join(self.root, name) if name else self.root

    def listed(self, folder: str = "") -> list[fs.FileInfo]:
        """Files and folders right in a folder, by name; none where it isn't there."""
        return sorted(self.files.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True)), key=lambda f: f.path)

    def bytes_of(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        with self.files.open_input_file(self.at(name)) as f:
            return f.read_at(f.size() - start if size is None else size, start)

    def write(self, name: str, data: bytes) -> None:
        """A whole file, moved to its name once it is complete."""
        at = self.at(name)
        self.files.create_dir(posixpath.dirname(at), recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with self.files.open_output_stream(part) as f:
            f.write(data)
        self.files.move(part, at)

    def exists(self, name: str) -> bool:
        return self.files.get_file_info(self.at(name)).type != fs.FileType.NotFound


def manifest(store: Store) -> pa.Table | None:
    """The manifest in force; None for a folder that no sink wrote."""
    if not store.exists(CURRENT):
        return None
    return pq.read_table(io.BytesIO(store.bytes_of(store.bytes_of(CURRENT).decode())))


def vacuum(uri: str) -> int:
    """Deletes files and manifests of earlier and failed writes; how many files went. Not while a write is under way."""
    store = Store(uri)
    held = manifest(store)
    if held is None:
        raise FileNotFoundError(f"{uri} was not written by a sink of this library")
    keep = {CURRENT, store.bytes_of(CURRENT).decode(), *held["file"].to_pylist()}
    gone = 0
    for f in store.files.get_file_info(fs.FileSelector(store.root, recursive=True)):
        if f.type == fs.FileType.File and f.path[len(store.root) :].lstrip("/") not in keep:
            store.files.delete_file(f.path)
            gone += 1
    return gone


@dataclass
class Wrote(WriterCommitMessage):
    rows: list[dict]


class VersionedWriter(DataSourceArrowWriter):
    """A sink whose tasks write files and return a manifest row for each. key: the manifest's columns that name an array."""

    key: tuple[str, ...] = ()

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.version = uri, overwrite, uuid.uuid4().hex

    def files_of(self, iterator, store: Store, folder: str):
        """Writes arrays into the folder and yields their manifest rows."""
        raise NotImplementedError

    def write(self, iterator) -> Wrote:
        return Wrote(list(self.files_of(iterator, Store(self.uri), f"{self.version}/{uuid.uuid4().hex}")))  # a folder for each attempt

    def commit(self, messages: list[Wrote | None]) -> None:
        store = Store(self.uri)
        rows = [r for m in messages if m is not None for r in m.rows]
        names = [tuple(r[k] for k in self.key) for r in rows]
        if len(set(names)) < len(names):
            raise ValueError("an array came from two tasks; deal the rows by " + ", ".join(self.key))
        old = None if self.overwrite else manifest(store)
        if old is not None:
            seen = set(names)
            rows = [r for r in old.to_pylist() if tuple(r[k] for k in self.key) not in seen] + rows
        out, name = io.BytesIO(), f"_manifests/{self.version}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, self.schema), out)
        store.write(name, out.getvalue())
        store.write(CURRENT, name.encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        store = Store(self.uri)
        if store.exists(self.version):
            store.files.delete_dir(store.at(self.version))


def runs(batches, names: tuple[str, ...]):
    """Rows that come sorted by `names`, cut into (values of names, table) wherever these change; a run may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = [b.column(b.schema.get_field_index(n)).dictionary_encode().indices.to_numpy(zero_copy_only=False) for n in names]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            part = b.slice(i, j - i)
            key = tuple(part.column(part.schema.get_field_index(n))[0].as_py() for n in names)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(part)
    if held:
        yield last, pa.Table.from_batches(held)
