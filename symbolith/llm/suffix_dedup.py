"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of shards.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller id. Each WIDTH-byte window
has an anchor, the smallest hash among its GRAM-byte grams, so equal windows have equal anchors. Windows are spread by
anchor in three steps that lose none:

1. Groups of GROUP rows of a file, or one text of more than LONG bytes, list their anchors, each with the one text of the
   group that has it or a mark for several. Where all lists of an anchor meet, it is known whether different texts share it.
   Very frequent anchors come once for each group, not for each row. The number of parts follows the bytes of all texts.
2. Behind the shared anchors of its group each row, one at a time, cuts its runs of windows that have a shared anchor into
   snippets. Equal snippets of an anchor are one string with its smallest id.
3. The strings of an anchor meet in one task. A few anchors at a time, the strings are dealt out to SHARDS shards, each is
   transformed, and the transforms are merged by interleave refinement (module bwt). The repeated intervals of
   depth WIDTH give each window the smallest id that has it. Windows of a row with a larger id are removed, and the
   row's spans are the union of these windows.

A text that equals one of a row with a smaller id is removed whole, if it has WIDTH bytes, and takes no part in 2 and
3, so groups of copies cost nothing there. An anchor whose strings exceed LARGE bytes is split before they meet: its strings
become single windows, whose hash is their anchor, so that any number of tasks share them.

A string is named by its anchor, a 64-bit hash and its length. Where the strings of an anchor meet, two of one name are an
error that asks for another seed, never a wrong result.

Cases: a null text counts as empty; texts shorter than WIDTH bytes lose nothing; matches never cross rows, as a window
lies within one string; rows of equal id don't remove from each other; a null id counts as larger than every other;
ids are whole numbers; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, by_rows, drop, free, keyed, ship, slices, stash

WIDTH, GRAM, GROUP, SHARDS, CHUNK, LARGE, LONG, PART = 50, 24, 512, 4, 600_000, 2_000_000, 65_536, 32_000_000
SENT = 4_000_000  # bytes of a batch that a task hands on
NO_ID = np.iinfo(np.int64).max
_FACTOR = 0x9E3779B97F4A7C15
_SEVERAL = 0xFFFF


def _byte_hashes() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


_BYTE = _byte_hashes()


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash (48 bits) of each run of size bytes, by doubling; the last size - 1 values don't count. Hashes only say
    where equal windows may meet: unequal ones that collide are told apart by their bytes."""
    part, n, out, have = _BYTE[text], 1, None, 0
    while True:
        if size & n:
            if out is None:
                out, have = part.copy(), n
            else:
                out = out * np.uint64(pow(_FACTOR, n, 1 << 64))
                out[: len(text) - have] += part[have:]
                have += n
        if 2 * n > size:
            break
        twice = part * np.uint64(pow(_FACTOR, n, 1 << 64))
        twice[:-n] += part[n:]
        part, n = twice, 2 * n
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out & np.uint64(0xFFFFFFFFFFFF)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, as many as there are whole runs."""
    out, n = values.copy(), 1
    while n < width:
        step = min(n, width - n)
        out = np.minimum(out[:-step], out[step:])
        n += step
    return out


def _packed(hashes: np.ndarray) -> bytes:
    """The lower 6 bytes of each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def anchor_runs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and anchors of the runs of windows of a text that have one anchor."""
    if len(text) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(np.frombuffer(text, np.uint8), GRAM)[: len(text) - GRAM + 1]
    least = sliding_least(hashes, WIDTH - GRAM + 1)
    starts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    return starts, least[starts]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: file (a hash), group, index, doc_id, id (for comparison), text."""
    index = F.col(ROW_INDEX)
    group = F.when(F.coalesce(F.octet_length(text_col), F.lit(0)) > LONG, -1 - index).otherwise(F.floor(index / GROUP).cast("long"))
    return keyed(docs).select(
        F.xxhash64(ROW_FILE).alias("file"), group.alias("group"), index.alias("index"),
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def anchor_lists(rows: DataFrame, n_parts: int) -> DataFrame:
    """Per group and part of the anchors: part, file, group, the anchors (sorted), of each the number of its text in
    texts or _SEVERAL, and texts (the first 8 bytes of a text's SHA-256)."""

    def over(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], list] = {}

        def close(key):
            anchors, texts = zip(*held.pop(key), strict=True)
            own = np.repeat(np.arange(len(texts), dtype=np.uint16), [len(a) for a in anchors])
            h = np.concatenate(anchors)
            if not len(h):
                return
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first = np.r_[True, h[1:] != h[:-1]][: len(h)]
            texts = np.array(texts, np.uint64)
            name = texts[own] if len(h) else texts[:0]
            at = np.cumsum(first) - 1
            several = np.zeros(int(first.sum()), bool)
            several[at[name != name[np.flatnonzero(first)][at]]] = True
            h, own = h[first], np.where(several, np.uint16(_SEVERAL), own[first])
            part = ((h >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
            out = []
            for k in [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]:
                used, number = np.unique(own[k][own[k] != _SEVERAL], return_inverse=True)  # of the texts only those of the part travel
                mine = np.full(len(k), _SEVERAL, np.uint16)
                mine[own[k] != _SEVERAL] = number
                out.append((int(part[k[0]]), *key, _packed(h[k]), mine.tobytes(), texts[used].tobytes()))
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "file", "group", "anchors", "numbers", "texts"])

        for batch in slices(batches, 2):
            for f, g, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (f, g)
                if key not in held:
                    for other in list(held) if g >= 0 else []:  # rows come in the order of the file
                        yield from close(other)
                    held[key] = []
                held[key].append((np.unique(anchor_runs(text)[1]), int.from_bytes(hashlib.sha256(text).digest()[:8], "little")))
                if g < 0:
                    yield from close(key)
        for other in list(held):
            yield from close(other)

    return rows.select("file", "group", F.col("text").cast("binary").alias("text")).mapInArrow(over, "part long, file long, group long, anchors binary, numbers binary, texts binary")


def shared_anchors(lists: DataFrame, n_parts: int) -> DataFrame:
    """Per group and part: file, group, the anchors (sorted) that different texts share."""

    def over(batches):
        import pyarrow as pa

        held: list[tuple] = []
        part = None

        def close():
            h = np.concatenate([_unpacked(a) for _, _, a, _, _ in held])
            name = np.concatenate([np.r_[np.frombuffer(t, np.uint64), np.uint64(0)][np.minimum(np.frombuffer(o, np.uint16), len(t) // 8)] for _, _, _, o, t in held])
            several = np.concatenate([np.frombuffer(o, np.uint16) == _SEVERAL for _, _, _, o, _ in held])
            order = np.argsort(h, kind="stable")
            line = h[order]
            first = np.r_[True, line[1:] != line[:-1]]
            at = np.cumsum(first) - 1
            odd = several[order] | (name[order] != name[order][np.flatnonzero(first)][at])
            shared = np.zeros(at[-1] + 1, bool)
            shared[at[odd]] = True
            mine = np.empty(len(h), bool)
            mine[order] = shared[at]
            out, start = [], 0
            for f, g, a, _, _ in held:
                own = _unpacked(a)
                if (keep := mine[start : start + len(own)]).any():
                    out.append((f, g, own[keep].tobytes()))
                start += len(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "group", "anchors"])

        for batch in batches:
            for p, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield from close()
                    held = []
                part = p
                held.append(tuple(rest))
        if held:
            yield from close()

    return lists.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(over, "file long, group long, anchors binary")


def _name(snippet: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(snippet, 5) - (1 << 63)


def snippets(rows: DataFrame, shared: DataFrame, leaders: DataFrame) -> DataFrame:
    """Runs of windows with a shared anchor, of the rows that stand for their text: anchor, string (a hash of the
    snippet), id, file, index, start, n (windows), sent, and the snippet, but only where the string is new in its group or its id
    smaller than before. A task holds the anchors of one group, one text, and a batch to hand on."""

    def over(batches):
        import pyarrow as pa

        group, lead, blobs, known, seen = None, None, [], np.zeros(0, np.uint64), {}
        parts, names, out, size = [], [], [], 0

        def close():
            anchors, ids, file, index, starts, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            sent = [x is not None for x in out]
            columns = [pa.array(anchors), pa.array(names, pa.int64()), pa.array(ids), pa.array(file), pa.array(index), pa.array(starts.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sent), pa.array(out, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "string", "id", "file", "index", "start", "n", "sent", "snippet"])

        for batch in slices(batches, 5):
            for f, g, i, own, anchors, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (f, g):
                    group, lead, blobs, seen = (f, g), None, [], {}
                if anchors is not None:
                    blobs.append(np.frombuffer(anchors, np.uint64))
                elif text is None:
                    lead = i
                elif lead == i and blobs:
                    if len(blobs) > 1 or known is not blobs[0]:
                        known = np.sort(np.concatenate(blobs))
                        blobs = [known]
                    starts, found = anchor_runs(text)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    mine = np.flatnonzero(known[at] == found)
                    ends = np.r_[starts[1:], len(text) - WIDTH + 1][mine]
                    starts, found = starts[mine], found[mine].view(np.int64)
                    # a text of very many runs goes on in pieces
                    for k in range(0, len(mine), 50_000):
                        piece = slice(k, k + 50_000)
                        m = len(found[piece])
                        parts.append((found[piece], *(np.full(m, x) for x in (own, f, i)), starts[piece], (ends - starts)[piece]))
                        for a, b, h in zip(starts[piece].tolist(), (ends[piece] + WIDTH - 1).tolist(), found[piece].tolist(), strict=True):
                            snippet = text[a:b]
                            name = _name(snippet)
                            names.append(name)
                            size += 60
                            if seen.get((h, name), NO_ID + 1) <= own:
                                snippet = None
                            else:
                                if len(seen) >= 200_000:
                                    seen.clear()  # strings are sent again then
                                seen[h, name] = own
                                size += len(snippet)
                            out.append(snippet)
                        if size >= SENT:
                            yield close()
                            parts, names, out, size = [], [], [], 0
        if parts:
            yield close()

    empty = lambda kind: F.lit(None).cast(kind)
    every = (
        shared.select("file", "group", F.lit(-1).cast("long").alias("index"), empty("long").alias("id"), "anchors", empty("binary").alias("text"))
        .unionByName(leaders.select("file", "group", "index", empty("long").alias("id"), empty("binary").alias("anchors"), empty("binary").alias("text")))
        .unionByName(rows.select("file", "group", "index", "id", empty("binary").alias("anchors"), F.col("text").cast("binary").alias("text")))
    )
    order = every.repartition("file", "group").sortWithinPartitions("file", "group", "index", F.col("text").isNotNull())
    return order.mapInArrow(over, "anchor long, string long, id long, file long, index long, start int, n int, sent boolean, snippet binary")


def least_ids(strings: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """Of each window of each string the least id of the strings that have it."""
    from .bwt import merged_blocks

    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    bounds = sorted({0, *ends[np.minimum(np.searchsorted(ends, len(text) * np.arange(1, SHARDS + 1) // SHARDS), len(ends) - 1)].tolist()})
    shards = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    block = np.concatenate(merged_blocks(shards, WIDTH))
    n = sizes - WIDTH + 1
    first = np.cumsum(n) - n
    window = np.repeat(starts - first, n) + np.arange(n.sum())
    least = np.full(int(block.max()) + 1, NO_ID)
    np.minimum.at(least, block[window], np.repeat(ids, n))
    return np.split(least[block[window]], first[1:])


def resolved(anchor: np.ndarray, strings: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """least_ids for the strings of whole anchors, sorted by anchor. An anchor's only string meets no other one."""
    new = np.r_[True, anchor[1:] != anchor[:-1], True]
    alone = new[1:] & new[:-1]
    several = np.flatnonzero(~alone)
    out: list[np.ndarray] = [ids[k : k + 1] for k in range(len(strings))]
    if len(several):
        for k, x in zip(several.tolist(), least_ids([strings[k] for k in several], ids[several]), strict=True):
            out[k] = x[:1] if (x == x[0]).all() else x
    return out


def window_ids(strings: DataFrame) -> DataFrame:
    """strings: anchor, snippet, id (the smallest). Per string: anchor, string, n, and the least id of its windows
    if all have the same, else that of each window as bytes."""

    def over(batches):
        import pyarrow as pa

        held: list[tuple[int, bytes, int]] = []
        size = 0

        def close(rows):
            found = resolved(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
            names = [(r[0], _name(r[1]), len(r[1]) - WIDTH + 1) for r in rows]
            if len(set(names)) < len(names):
                raise ValueError("two strings of one anchor have one hash; choose another seed for _name")
            columns = [*zip(*names, strict=True), [int(x[0]) if len(x) == 1 else None for x in found], [x.tobytes() if len(x) > 1 else None for x in found]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "string", "n", "same", "least"])

        for batch in slices(batches, 1):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield from close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield from close(held)

    return strings.select("anchor", "snippet", "id").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(over, "anchor long, string long, n int, same long, least binary")


def large_anchors(found: DataFrame, n_bytes: int) -> DataFrame | None:
    """anchor of each whose strings have more than LARGE bytes, None if there is none. Buckets of anchors are summed first, so
    that few anchors need a sum of their own."""
    n = max(65_536, 8 * n_bytes // LARGE)
    sent = found.filter("sent").select("anchor", (F.col("n") + WIDTH - 1).cast("long").alias("size"), F.pmod("anchor", F.lit(n)).alias("bucket"))
    heavy = stash(sent.groupBy("bucket").agg(F.sum("size").alias("all")).filter(F.col("all") > LARGE).select("bucket"), "heavy")
    if heavy.isEmpty():
        return None
    own = sent.join(heavy, "bucket").groupBy("anchor").agg(F.sum("size").alias("all")).filter(F.col("all") > LARGE)
    return stash(own.select("anchor"), "large")


def split_windows(strings: DataFrame) -> DataFrame:
    """window_ids for the strings of large anchors: each window is a string of its own, under its hash."""

    def over(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        columns = ["anchor", "string", "n", "k", "snippet", "id"]
        for batch in slices(batches, 1, 200_000):
            for anchor, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, name = len(text) - WIDTH + 1, _name(text)
                for start in range(0, n, 50_000):
                    at = range(start, min(n, start + 50_000))
                    cells = [[anchor] * len(at), [name] * len(at), [n] * len(at), at, [text[k : k + WIDTH] for k in at], [own] * len(at)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], columns)

    windows = strings.select("anchor", "snippet", "id").mapInArrow(over, "anchor long, string long, n int, k int, snippet binary, id long")
    windows = stash(windows.withColumn("of", F.xxhash64("snippet")), "single-windows")
    least = window_ids(windows.groupBy(F.col("of").alias("anchor"), "snippet").agg(F.min("id").alias("id")))
    least = least.select(F.col("anchor").alias("of"), F.col("string").alias("name"), F.coalesce("same", F.lit(NO_ID)).alias("same"))

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.append_column("name", pa.array(map(_name, batch.column(4).to_pylist()), pa.int64()))

    known = windows.mapInArrow(named, "anchor long, string long, n int, k int, snippet binary, id long, of long, name long").drop("snippet", "id").join(least, ["of", "name"])
    lists = known.groupBy("anchor", "string", "n").agg(F.sort_array(F.collect_list(F.struct("k", "same"))).alias("l")).select("anchor", "string", "n", F.col("l.same").alias("l"))

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            blobs = [np.array(x, np.int64).tobytes() for x in batch.column(3).to_pylist()]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], none, pa.array(blobs, pa.binary())], ["anchor", "string", "n", "same", "least"])

    return lists.mapInArrow(packed, "anchor long, string long, n int, same long, least binary")


def _merged(runs: np.ndarray) -> list[tuple[int, int]]:
    """Spans that windows cover, given runs of their starts (first, behind the last)."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(runs[:, 1]) + WIDTH - 1
    new = np.flatnonzero(np.r_[True, runs[1:, 0] > ends[:-1]])
    return list(zip(runs[new, 0].tolist(), ends[np.r_[new[1:] - 1, len(runs) - 1]].tolist(), strict=True))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    done, out = 0, []
    for a, b in spans:
        out.append(text[done:a])
        done = b
    return b"".join([*out, text[done:]])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: file, group, index (see _rows), doc_id, n_bytes, whole (all of it goes), starts (runs of the starts of removed windows, as bytes; null for none)."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, id_col, text_col)
    digest = stash(
        rows.select("file", "group", "index", "doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digest"
    )
    n_bytes = digest.agg(F.sum("n_bytes")).first()[0] or 0
    n_parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // PART)
    best = stash(digest.groupBy("sha").agg(F.min(F.struct("id", "file", "index")).alias("best"), F.count("*").alias("copies")), "texts")
    known = stash(digest.join(best.filter("copies > 1").select("sha", "best"), "sha", "left").select(
        "file", "group", "index", "doc_id", "id", "n_bytes", "sha",
        (F.coalesce(F.col("id") > F.col("best.id"), F.lit(False)) & (F.col("n_bytes") >= WIDTH)).alias("whole"),
        F.coalesce((F.col("file") == F.col("best.file")) & (F.col("index") == F.col("best.index")), F.lit(True)).alias("lead"),
        F.col("best.file").alias("of_file"), F.col("best.index").alias("of_index"),
    ), "known")
    shared = stash(shared_anchors(anchor_lists(rows, n_parts), n_parts), "shared")
    free(spark)
    leaders = known.filter(F.col("lead") & (F.col("n_bytes") >= WIDTH))
    found = stash(snippets(rows, shared, leaders), "snippets")
    free(spark)
    large = large_anchors(found, n_bytes)
    sent = found.filter("sent")
    meet = lambda f: f.groupBy("anchor", "snippet").agg(F.min("id").alias("id"))
    if large is None:
        least = stash(window_ids(meet(sent)), "windows")
    else:
        few, many = sent.join(large, "anchor", "left_anti"), sent.join(large, "anchor", "left_semi")
        least = stash(window_ids(meet(few)).unionByName(split_windows(meet(many))), "windows")
    free(spark)

    def over(batches):
        import pyarrow as pa

        for batch in slices(batches, 5):
            file, index, ids, starts, sizes, leasts = (c.to_pylist() for c in batch.columns)
            out = []
            for f, i, own, start, n, blob in zip(file, index, ids, starts, sizes, leasts, strict=True):
                if blob is None:
                    runs = [[start, start + n]]
                else:
                    late = np.frombuffer(blob, np.int64) < own
                    runs = np.flatnonzero(np.diff(np.r_[False, late, False])).reshape(-1, 2) + start
                if len(runs):
                    out.append((f, i, np.asarray(runs, np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "index", "starts"])

    late = (
        found.select("anchor", "string", "file", "index", "id", "start", "n")
        .join(least, ["anchor", "string", "n"])
        .filter(F.col("same").isNull() | (F.col("same") < F.col("id")))
        .select("file", "index", "id", "start", "n", "least")
    )
    starts = late.mapInArrow(over, "file long, index long, starts binary").groupBy("file", "index").agg(F.array_join(F.collect_list(F.hex("starts")), "").alias("hex"))
    starts = stash(starts.select("file", "index", F.unhex("hex").alias("starts")), "starts")
    drop(found, least, shared)
    free(spark)
    # rows with the id of the row that stands for their text lose what that one loses
    by = starts.select(F.col("file").alias("f"), F.col("index").alias("i"), "starts")
    return known.join(by, (F.coalesce("of_file", "file") == F.col("f")) & (F.coalesce("of_index", "index") == F.col("i")), "left").select(
        "file", "group", "index", "doc_id", "n_bytes", "sha", "whole", F.when(~F.col("whole"), F.col("starts")).alias("starts")
    )


def reports(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    marks = stash(marked(docs, id_col, text_col), "marks")
    changed = marks.filter(F.col("starts").isNotNull())
    rows = _rows(docs, id_col, text_col).select("file", "index", F.col("text").cast("binary").alias("text"))

    def counted(batch):
        import pyarrow as pa

        out = []
        for doc, n, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "text", "starts")), strict=True):
            spans = _merged(np.frombuffer(starts, np.int32).astype(np.int64).reshape(-1, 2))
            kept = _cut(text, spans)
            out.append((doc, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        types = (batch.column(0).type, *[pa.int64()] * 3, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = rows.join(changed.select("file", "index", "doc_id", "n_bytes", "starts"), ["file", "index"]).select("doc_id", "text", "n_bytes", "starts").mapInArrow(by_rows(counted), schema)
    none = hashlib.sha256(b"").hexdigest()
    plain = marks.filter(F.col("starts").isNull()).select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("whole"), 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("whole"), none).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return plain.unionByName(cut)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return reports(spark.read.parquet(f"{sf_dir}/documents.parquet"))
