"""URL rules looked up in sorted digest arrays.

A list of entries (a host and the start of a path, such as ``example.org/news/``) is kept as a sorted array of
64-bit xxHash keys beside the entries' full strings. Workers get it as one broadcast value, put it into an unnamed
file of their own and memory-map it. A batch of URLs makes its candidate strings (the host's endings of a length
that some entry has, then the path's beginnings of a length that the host's entries have), probes all of them by
vectorised binary search, and compares the full strings, so a hash collision cannot give a wrong verdict. URLs are
judged where they are read: nothing is shuffled, however common a host is.

A list is broadcast, so its size is bounded: more than ``MAX_ENTRIES`` entries are refused with an error.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no entry; repeated rows are
judged alike; an empty table or an empty list is fine; of several fitting entries the longest string wins, then the
one with the longer host; an entry listed twice counts once, with its first value.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 5_000_000

Entry = tuple[str, str, str]  # host, beginning of the path, value

_HOST_END = re.compile(rb"[/?#]")
_PATH_END = re.compile(rb"[?#]")


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z in lower case) and path of a URL."""
    at = (url or b"").find(b"://")
    if at < 0:
        return b"", b""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    if not end:
        return rest.lower(), b""
    path = rest[end.start() :]
    stop = _PATH_END.search(path)
    return rest[: end.start()].lower(), path[: stop.start()] if stop else path


def _array(strings: list[bytes]) -> dict[str, np.ndarray]:
    """Keys in ascending order with the strings they stand for."""
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    text = [strings[i] for i in order]
    ends = np.cumsum([0, *map(len, text)], dtype=np.int64)
    return {"keys": keys[order], "ends": ends, "text": np.frombuffer(b"".join(text), np.uint8), "order": order}


def build(entries: Iterable[Entry]) -> bytes:
    """The digest arrays of a list, as bytes that ``Digests`` maps."""
    seen: dict[tuple[bytes, bytes], str] = {}
    for host, path, value in entries:
        seen.setdefault((host.encode().lower(), path.encode()), value)
    if len(seen) > MAX_ENTRIES:
        raise ValueError(f"{len(seen)} entries; a broadcast list may have {MAX_ENTRIES}")
    lengths: dict[bytes, set[int]] = {}
    for host, path in seen:
        lengths.setdefault(host, set()).add(len(path))
    hosts = _array(list(lengths))
    of_host = [sorted(lengths[h], reverse=True) for h in np.array([*lengths, None], object)[hosts["order"]]]
    values = sorted(set(seen.values()))
    rules = _array([h + p for h, p in seen])
    number = np.array([values.index(v) for v in seen.values()], np.int64)[rules["order"]]
    host_size = np.array([len(h) for h, _ in seen], np.int64)[rules["order"]]
    parts = {
        "host_keys": hosts["keys"], "host_ends": hosts["ends"], "host_text": hosts["text"],
        "path_ends": np.cumsum([0, *map(len, of_host)], dtype=np.int64),
        "paths": np.array([n for sizes in of_host for n in sizes], np.int64),
        "rule_keys": rules["keys"], "rule_ends": rules["ends"], "rule_text": rules["text"],
        "rule_value": number, "rule_host": host_size,
    }
    places, body, at = {}, [], 0
    for name, part in parts.items():
        data = part.tobytes() + b"\0" * (-part.nbytes % 8)
        places[name] = (at, len(part), part.dtype.str)
        body.append(data)
        at += len(data)
    sizes = sorted({len(h) for h in lengths}, reverse=True)
    head = json.dumps({"places": places, "values": values, "host_sizes": sizes}).encode()
    return len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8) + b"".join(body)


class Digests:
    """A memory-mapped list."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:  # without a name: it goes with the worker
            file.write(data)
            file.flush()
            mapped = np.memmap(file, np.uint8, "r")
        size = int.from_bytes(bytes(mapped[:8]), "little")
        head = json.loads(bytes(mapped[8 : 8 + size]))
        start = 8 + size + -size % 8
        self.values, self.host_sizes = head["values"], head["host_sizes"]
        for name, (at, n, kind) in head["places"].items():
            stop = start + at + n * np.dtype(kind).itemsize
            setattr(self, name, mapped[start + at : stop].view(kind))

    def _probe(self, which: str, strings: list[bytes]) -> np.ndarray:
        """Where each string is in the list; -1 if it is not."""
        keys, ends, text = (getattr(self, f"{which}_{x}") for x in ("keys", "ends", "text"))
        wanted = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        at = np.searchsorted(keys, wanted)
        found = np.full(len(strings), -1)
        for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else []):
            k = int(at[i])
            while k < len(keys) and keys[k] == wanted[i]:
                if bytes(text[ends[k] : ends[k + 1]]) == strings[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def longest(self, parts: list[tuple[bytes, bytes]]) -> list[tuple[str, str] | None]:
        """The longest fitting entry of each (host, path), as text and value."""
        owner, endings = [], []
        for i, (host, _) in enumerate(parts):
            for n in self.host_sizes:
                if n == len(host) or n < len(host) and host[-n - 1] == 46 and n:
                    owner.append(i)
                    endings.append(host[len(host) - n :])
        owners, candidates = [], []
        for i, ending, k in zip(owner, endings, self._probe("host", endings)):
            if k >= 0:
                path = parts[i][1]
                for n in self.paths[self.path_ends[k] : self.path_ends[k + 1]].tolist():
                    if n <= len(path):
                        owners.append(i)
                        candidates.append(ending + path[:n])
        best: list[tuple[int, int, int] | None] = [None] * len(parts)
        for i, text, k in zip(owners, candidates, self._probe("rule", candidates)):
            if k >= 0:
                rank = (len(text), int(self.rule_host[k]), int(k))
                best[i] = rank if best[i] is None else max(best[i], rank)
        return [
            b and (bytes(self.rule_text[self.rule_ends[b[2]] : self.rule_ends[b[2] + 1]]).decode(),
                   self.values[self.rule_value[b[2]]])
            for b in best
        ]


_mapped: dict[int, Digests] = {}


def _open(broadcast) -> Digests:
    """The list of a broadcast value, mapped once per worker."""
    data = broadcast.value
    key = xxhash.xxh64_intdigest(data)
    if key not in _mapped:
        _mapped[key] = Digests(data)
    return _mapped[key]


JUDGED = "host string, path string, rule string, verdict string"


def judge(
    urls: DataFrame, rules: Iterable[Entry], blocked: Iterable[Entry], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Id, host, path, the longest fitting rule and the verdict of every URL.

    A rule's value is the verdict of the URLs that it fits; any other URL is blocked if an entry of ``blocked`` fits.
    """
    context = urls.sparkSession.sparkContext
    lists = context.broadcast(build(rules)), context.broadcast(build(blocked))
    kind = urls.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, block = map(_open, lists)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            rule, hit = ruled.longest(parts), block.longest(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.decode(errors="replace") for h, _ in parts], pa.string()),
                    pa.array([p.decode(errors="replace") for _, p in parts], pa.string()),
                    pa.array([r and r[0] for r in rule], pa.string()),
                    pa.array([r[1] if r else "block" if b else "allow" for r, b in zip(rule, hit)], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict"],
            )

    rows = urls.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").cast("binary"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, {JUDGED}").withColumnRenamed("id", id_col)


def entries(rows: DataFrame, host_col: str, path_col: str, value_col: str) -> list[Entry]:
    """A list kept as a table; its size is checked before it is fetched."""
    if (n := rows.count()) > MAX_ENTRIES:
        raise ValueError(f"{n} entries; a broadcast list may have {MAX_ENTRIES}")
    known = rows.where(F.col(host_col).isNotNull() & F.col(path_col).isNotNull())
    return [tuple(r) for r in known.select(host_col, path_col, F.coalesce(value_col, F.lit("block"))).toLocalIterator()]
