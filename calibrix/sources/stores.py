"""Files of the data sources: opened and listed through Arrow's file systems,
so that a path may be local or in any store Arrow reaches (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

from pyarrow import fs


class Store:
    """A file system and the text that leads from its paths to full names."""

    def __init__(self, uri: str):
        # Spark names local files file:/x.
        local = uri.removeprefix("file:") if uri.startswith("file:/") else None
        if local is not None or "://" not in uri:
            self.fs, self.base, self.prefix = fs.LocalFileSystem(), "/" + (local or uri).lstrip("/"), "file:"
            if local is None and not uri.startswith("/"):
                raise ValueError(f"{uri}: give an absolute path")
        else:
            self.fs, self.base = fs.FileSystem.from_uri(uri)
            self.prefix = uri[:uri.rindex(self.base)] if self.base in uri else ""

    def files(self, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
        """(path, bytes) of the files at or below the base, hidden ones aside."""
        info = self.fs.get_file_info(self.base)
        if info.type == fs.FileType.File:
            return [(info.path, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.prefix + self.base)
        found = self.fs.get_file_info(fs.FileSelector(self.base, recursive=True))
        shown = lambda p: not any(part[:1] in "._" for part in p[len(self.base):].split("/") if part)
        return sorted((f.path, f.size) for f in found
                      if f.type == fs.FileType.File and f.path.endswith(suffixes) and shown(f.path))


def packed(files: list[tuple[str, int]], limit: int, open_cost: int) -> list[list[str]]:
    """Files in groups of at most ``limit`` bytes (one larger file is a group),
    the largest first; each file counts ``open_cost`` more."""
    groups, now, size = [], [], 0
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        if now and size + n > limit:
            groups.append(now)
            now, size = [], 0
        now.append(path)
        size += n + open_cost
    return [*groups, now] if now else groups
