"""Fuzzy passages that documents share, by collinear chaining of shared word k-mers.

Words are runs other than ASCII white space, with A to Z in lower case. A text's seeds are minimizers on two scales: of its
five-word shingles in windows of WINDOWS[0], which find changed passages, and of its runs of LEAST_WORDS words in windows of
WINDOWS[1], which make sure of unchanged ones.

1. Groups of GROUP rows of a file, or one text of more than LONG bytes, list their seeds, each once with its first place by
   id. Where all lists of a seed meet, the place with the smallest id, its home, is told to all groups that have the seed. So
   a passage of very many documents gives each of them links to its home, never all pairs.
2. Each text orders its seeds' places by home document and chains them: a chain's score is its seeds less a cost for
   every word of a gap, and the best predecessor of a place, one that lies before it in both texts, is the largest prefix
   maximum of a Fenwick tree over places in the home. Chains part where a gap exceeds GAP words.
3. Chains travel to their home's text with the words around them and are aligned: gaps between seeds by least edits, and
   beyond the outer seeds across edits, as far as the score lasts. A chain whose alignment reaches the end of the words it
   was sent with travels again with its whole text. Stretches of LEAST_WORDS words and a similarity of SIMILARITY (equal words
   over the longer side) are kept. Where very many chains share a home its text is copied to several tasks, HOT chains for each.

What is found: two texts with LEAST_WORDS + WINDOWS[1] - 1 (39) equal words in a row have a long seed in common, so each is told
with a passage of the same row, its home, or one of them is that home: rows are links to representatives, and texts with the
same representative are linked to each other. Of changed passages those are found that keep a five-word seed whose home is
the text in question; README has the measured recall. A seed alone, without another shared seed within GAP words, isn't
followed. Of a passage that its home has several times the first place is told.

Texts that are equal as they stand are one class, led by the row of the smallest id: only leaders take part in 2 and
3, and other rows are told as copies of their leader.

Cases: a null text counts as empty; texts of fewer words than a seed have none; a null id counts as larger than every other, and
rows of one id are told apart by file and position; equal rows are copies; an empty table gives an empty result; other columns
don't matter. Ids are whole numbers. Word numbers start at 0 and ends are exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, drop, free, keyed, ship, slices, stash

GROUP, GAP, GAP_COST, LEAST_WORDS, SIMILARITY, HOT = 512, 40, 0.04, 30, 0.8, 1000
SEEDS, WINDOWS = (5, LEAST_WORDS), (8, 10)
#: Words sent along on both sides of a cluster of shared seeds, and at most beyond a chain.
MARGIN, WIDE = 24, 160
#: How far an extension looks for where texts agree again, the loss of score at which it ends, and the similarity that scores nothing.
AGAIN, LOSS, EVEN = 6, 8.0, 0.7
LONG, PART, SENT = 65_536, 8_000_000, 4_000_000
NO_ID = np.iinfo(np.int64).max
_HOME = np.dtype([("seed", "<i8"), ("id", "<i8"), ("file", "<i8"), ("index", "<i8"), ("at", "<i4")])
_PLACE = np.dtype([("seed", "<i8"), ("id", "<i8"), ("index", "<i8"), ("at", "<i4"), ("several", "?")])
_FACTOR = 0x9E3779B97F4A7C15


class _Tables:
    """Powers of _FACTOR and of its inverse, and a number for each byte: 0 for white space, the same for A to Z as for a to z."""

    def __init__(self):
        self.byte = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64)
        self.byte[65:91] = self.byte[97:123]
        self.byte[[9, 10, 11, 12, 13, 32]] = 0
        self.power = self.inverse = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.power):
            size = max(2 * len(self.power), n, 1 << 16)
            made = []
            for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
                line = np.full(size, factor, np.uint64)
                line[0] = 1
                made.append(np.cumprod(line))
            self.power, self.inverse = made
        return self.power[:n], self.inverse[:n]


_tables = _Tables()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words of a text."""
    value = _tables.byte[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, value != 0, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    power, inverse = _tables.powers(len(value))
    value *= power
    return _mixed(np.add.reduceat(value, starts) * inverse[starts]), starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    return split_words(text)[0]


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over each run of width values."""
    out, n = values, 1
    while n < width:
        step = min(n, width - n)
        out = of(out[:-step], out[step:])
        n += step
    return out


def minimizers(words: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the shingles of `size` words that are least in a run of `window` shingles, in order."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _tables.powers(len(words))
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * power, out=sums[1:])
    h = _mixed((sums[size:] - sums[:-size]) * inverse[:n])
    width = min(window, n)
    least = _sliding(h, width, np.minimum)
    fill = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([fill, least, fill]), width, np.maximum) == h)  # the least of some run
    # where one word is said over and over every shingle is least: of equal seeds in a row one in `window` words does
    new = np.r_[True, (h[at[1:]] != h[at[:-1]]) | (at[1:] - at[:-1] >= window)]
    if not new.all():
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        step = (at - first) // window
        at = at[new | np.r_[True, step[1:] != step[:-1]]]
    return h[at], at


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds, odd ones of long runs, and the numbers of their first words, in order."""
    (h, a), (k, b) = (minimizers(words, size, window) for size, window in zip(SEEDS, WINDOWS, strict=True))
    found, at = np.r_[h & ~np.uint64(1), k | np.uint64(1)], np.r_[a, b]
    order = np.argsort(at, kind="stable")
    return found[order].view(np.int64), at[order].astype(np.int32)


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Disjoint chains of places (x[i], y[i]), sorted by x then y, in both of which they ascend."""
    level = {v: k + 1 for k, v in enumerate(np.unique(y).tolist())}
    best: list[tuple[float, int]] = [(-1e18, -1)] * (len(level) + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    waiting: list[int] = []  # places of the present x, which can't follow one another
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        if waiting and xs[waiting[0]] != a:
            for j in waiting:
                entry, k = (score[j] + GAP_COST * (xs[j] + ys[j]), j), level[ys[j]]
                while k < len(best):
                    if entry > best[k]:
                        best[k] = entry
                    k += k & -k
            waiting = []
        found, k = (-1e18, -1), level[b] - 1
        while k:
            if best[k] > found:
                found = best[k]
            k -= k & -k
        gain = found[0] - GAP_COST * (a + b)
        score[i], before[i] = (1 + gain, found[1]) if gain > 0 else (1.0, -1)
        waiting.append(i)
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (xs[chain[-1]] - xs[i] > GAP or ys[chain[-1]] - ys[i] > GAP):
                out.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def equal_words(a: list[int], b: list[int]) -> int:
    """Equal words in an alignment of a and b of fewest edits."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    if not a or not b:
        return n
    row = [(k, 0) for k in range(len(b) + 1)]  # edits, less equal words
    for i, v in enumerate(a, 1):
        new = [(i, 0)]
        for j, w in enumerate(b, 1):
            e, m = row[j - 1]
            new.append(min((e, m - 1) if v == w else (e + 1, m), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return n - row[-1][1]


Segment = tuple[int, int, int, int, int]  # start and end in own, start and end in home, equal words


def beyond(own: list[int], home: list[int], i: int, j: int) -> list[Segment]:
    """Segments from (i, j) on: equal words, and the words between them where the texts differ."""
    out: list[Segment] = []
    score = best = 0.0
    kept, n, m = 0, len(own), len(home)
    while i < n and j < m and score > best - LOSS:
        a = i
        while i < n and j < m and own[i] == home[j]:
            i, j = i + 1, j + 1
        if i > a:
            out.append((a, i, j - (i - a), j, i - a))
            score += (1 - EVEN) * (i - a)
            if score > best:
                best, kept = score, len(out)
        # the least step after which two words, or all that is left, agree
        for step in range(1, AGAIN + 1):
            to = next(
                ((x, y) for x, y in [(step, step), *((step, y) for y in range(step)), *((x, step) for x in range(step))]
                 if i + x < n and j + y < m and own[i + x] == home[j + y] and own[i + x + 1 : i + x + 2] == home[j + y + 1 : j + y + 2]), None
            )
            if to:
                break
        else:
            break
        out.append((i, i + to[0], j, j + to[1], 0))
        score -= EVEN * step
        i, j = i + to[0], j + to[1]
    return out[:kept]


def segments(own: list[int], home: list[int], places: list[tuple[int, int, int]]) -> list[Segment]:
    """An alignment along a chain of places (word in own, word in home, equal words), and beyond it on both sides."""
    out: list[Segment] = []
    i = j = None
    for a, b, size in places:
        if own[a : a + size] != home[b : b + size]:
            continue
        if i is not None and (a < i or b < j):
            if a - i == b - j and a + size > i:  # it goes on with what is aligned
                out.append((i, a + size, j, b + size, a + size - i))
                i, j = a + size, b + size
            continue
        if i is None:
            n, m = a, b
            before = beyond(own[:n][::-1], home[:m][::-1], 0, 0)
            out = [(n - y, n - x, m - w, m - v, same) for x, y, v, w, same in reversed(before)]
        elif (a, b) != (i, j):
            out.append((i, a, j, b, equal_words(own[i:a], home[j:b])))
        out.append((a, a + size, b, b + size, size))
        i, j = a + size, b + size
    return out + (beyond(own, home, i, j) if i is not None else [])


def _best(found: list[Segment], even: float) -> tuple[int, int] | None:
    """The consecutive segments of the best score, in which a similarity of `even` scores nothing."""
    best, score, start, to = 0.0, 0.0, 0, None
    for k, (a, b, c, d, same) in enumerate(found):
        score += same - even * max(b - a, d - c)
        if score > best:
            best, to = score, (start, k + 1)
        if score <= 0:
            score, start = 0.0, k + 1
    return to


def alike(found: list[Segment]) -> list[Segment]:
    """Of consecutive segments those that score best at EVEN, or else at SIMILARITY, joined, then what is left on both sides; each
    of LEAST_WORDS words and SIMILARITY at least."""
    out, todo = [], [found]
    while todo:
        part = todo.pop()
        if not part or part[-1][1] - part[0][0] < LEAST_WORDS:
            continue
        for even in (EVEN, SIMILARITY):
            if not (to := _best(part, even)):
                break
            own = part[slice(*to)]
            a, b, c, d, same = own[0][0], own[-1][1], own[0][2], own[-1][3], sum(p[4] for p in own)
            if same >= SIMILARITY * max(b - a, d - c) - 1e-9:
                break
        if to:
            if b - a >= LEAST_WORDS and same >= SIMILARITY * max(b - a, d - c) - 1e-9:
                out.append((a, b, c, d, same))
            todo += [part[: to[0]], part[to[1] :]]
    return sorted(out)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    index = F.col(ROW_INDEX)
    group = F.when(F.coalesce(F.octet_length(text_col), F.lit(0)) > LONG, -1 - index).otherwise(F.floor(index / GROUP).cast("long"))
    return keyed(docs).select(
        F.xxhash64(ROW_FILE).alias("file"), group.alias("group"), index.alias("index"),
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def _batch(rows: list[tuple], columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))


def seed_lists(rows: DataFrame, n_parts: int) -> DataFrame:
    """Per group and part of the seeds: part, file, group, places (the first of each seed by id, index and word)."""

    def over(batches):
        import pyarrow as pa

        columns = {"part": pa.int64(), "file": pa.int64(), "group": pa.int64(), "places": pa.binary()}
        held: dict[tuple[int, int], list] = {}

        def close(key):
            place = np.concatenate(held.pop(key))
            if not len(place):
                return
            place = place[np.lexsort((place["at"], place["index"], place["id"], place["seed"]))]
            first = np.r_[True, place["seed"][1:] != place["seed"][:-1]][: len(place)]
            at = np.cumsum(first) - 1
            odd = place["index"] != place["index"][np.flatnonzero(first)][at]
            several = np.zeros(int(first.sum()), bool)
            several[at[odd]] = True
            place = place[first]
            place["several"] = several
            part = (place["seed"] >> 20) % n_parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
            out = [(int(part[order[a]]), *key, place[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            if out:
                yield _batch(out, columns)

        for batch in slices(batches, 4):
            for file, group, index, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (file, group)
                if key not in held:
                    for other in list(held) if group >= 0 else []:  # rows come in the order of the file
                        yield from close(other)
                    held[key] = []
                found, at = seeds(word_hashes(text))
                place = np.zeros(len(found), _PLACE)
                place["seed"], place["id"], place["index"], place["at"] = found, own, index, at
                held[key].append(place)
                if group < 0:
                    yield from close(key)
        for other in list(held):
            yield from close(other)

    return rows.select("file", "group", "index", "id", "text").mapInArrow(over, "part long, file long, group long, places binary")


def homes(lists: DataFrame, n_parts: int) -> DataFrame:
    """Per group and part: file, group, homes: of each seed that several rows have, its first place."""

    def over(batches):
        import pyarrow as pa

        columns = {"file": pa.int64(), "group": pa.int64(), "homes": pa.binary()}
        held: list[tuple] = []
        part = None

        def close():
            place = [np.frombuffer(p, _PLACE) for _, _, p in held]
            every = np.concatenate(place)
            file = np.repeat(np.array([f for f, _, _ in held]), [len(p) for p in place])
            order = np.lexsort((every["index"], file, every["id"], every["seed"]))
            line = every["seed"][order]
            first = np.r_[True, line[1:] != line[:-1]]
            at = np.cumsum(first) - 1
            shared = np.bincount(at) > 1
            shared[at[every["several"][order]]] = True
            lead = order[first]
            home = np.zeros(len(lead), _HOME)
            for name in ("seed", "id", "index", "at"):
                home[name] = every[name][lead]
            home["file"] = file[lead]
            own = np.empty(len(every), np.int64)
            own[order] = at
            out, start = [], 0
            for (f, g, _), p in zip(held, place, strict=True):
                k = own[start : start + len(p)]
                start += len(p)
                if (k := k[shared[k]]).size:
                    out.append((f, g, home[k].tobytes()))
            if out:
                yield _batch(out, columns)

        for batch in slices(batches, 3):
            for p, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield from close()
                    held = []
                part = p
                held.append(tuple(rest))
        if held:
            yield from close()

    return lists.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(over, "file long, group long, homes binary")


def _found(words: np.ndarray, known: np.ndarray, file: int, index: int):
    """Chains of a text: home file, index and id, start and end of the words to send, places."""
    found, at = seeds(words)
    if not len(found):
        return
    k = np.minimum(np.searchsorted(known["seed"], found), len(known) - 1)
    ok = (known["seed"][k] == found) & ~((known["file"][k] == file) & (known["index"][k] == index))
    met, at = known[k[ok]], at[ok]
    if not len(met):
        return
    size = np.where(met["seed"] & 1, SEEDS[1], SEEDS[0])
    reach = np.maximum.accumulate(at + size)
    cuts = np.flatnonzero(np.r_[True, at[1:] - reach[:-1] > GAP, True])  # clusters of seeds, whatever their home
    low, high, several = np.repeat(at[cuts[:-1]], np.diff(cuts)), np.repeat(reach[cuts[1:] - 1], np.diff(cuts)), np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    order = np.lexsort((met["at"], at, met["index"], met["file"]))
    order = order[several[order] | (size[order] > SEEDS[0])]
    met, at, size, low, high = met[order], at[order], size[order], low[order], high[order]
    cuts = np.flatnonzero((met["index"][1:] != met["index"][:-1]) | (met["file"][1:] != met["file"][:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(met)], strict=True):
        for chain in [[0]] if b - a == 1 else chains(at[a:b], met["at"][a:b]) if b > a else ():
            first, last = a + chain[0], a + chain[-1]
            start = max(0, max(int(low[first]) - MARGIN, int(at[first]) - WIDE))
            end = min(len(words), min(int(high[last]) + MARGIN, int(at[last]) + WIDE + int(size[last])))
            places = np.stack([at[a:b][chain], met["at"][a:b][chain], size[a:b][chain]], 1).astype(np.int32)
            yield int(met["file"][a]), int(met["index"][a]), int(met["id"][a]), start, end, places.tobytes()


def chained(rows: DataFrame, home: DataFrame, leaders: DataFrame) -> DataFrame:
    """Chains of leaders that could be a passage: where they lead (file, index, other), whose they are (id, own_file, own_index),
    start (of the words sent along), n_words (of the text), places (word numbers and sizes) and words (a piece of the text). A task holds the homes of one group."""

    def over(batches):
        import pyarrow as pa

        columns = dict.fromkeys(["file", "index", "other", "id", "own_file", "own_index", "start", "n_words"], pa.int64()) | {"places": pa.binary(), "words": pa.binary()}
        group, lead, blobs, known = None, None, [], None
        out, size = [], 0
        for batch in slices(batches, 5):
            for f, g, i, own, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (f, g):
                    group, lead, blobs, known = (f, g), None, [], None
                if places is not None:
                    blobs.append(np.frombuffer(places, _HOME))
                elif text is None:
                    lead = i
                elif lead == i and (blobs or known is not None):
                    if blobs:
                        known = np.concatenate(blobs)
                        known, blobs = known[np.argsort(known["seed"])], []
                    words, starts, ends = split_words(text)
                    for file, index, other, start, end, line in _found(words, known, f, i):
                        sent = text[starts[start] : ends[end - 1]]
                        out.append((file, index, other, own, f, i, start, len(words), line, sent))
                        size += len(sent) + len(line) + 64
                        if size >= SENT:
                            yield _batch(out, columns)
                            out, size = [], 0
        if out:
            yield _batch(out, columns)

    empty = lambda kind: F.lit(None).cast(kind)
    every = (
        home.select("file", "group", F.lit(-1).cast("long").alias("index"), empty("long").alias("id"), "homes", empty("binary").alias("text"))
        .unionByName(leaders.select("file", "group", "index", empty("long").alias("id"), empty("binary").alias("homes"), empty("binary").alias("text")))
        .unionByName(rows.select("file", "group", "index", "id", empty("binary").alias("homes"), "text"))
    )
    order = every.repartition("file", "group").sortWithinPartitions("file", "group", "index", F.col("text").isNotNull())
    return order.mapInArrow(over, "file long, index long, other long, id long, own_file long, own_index long, start long, n_words long, places binary, words binary")


def _small(table: DataFrame) -> DataFrame:
    """table, of a few numbers a row, to be broadcast if it has a million rows at most; a plain join beyond."""
    return F.broadcast(table) if table.count() <= 1_000_000 else table


def passages(rows: DataFrame, chain: DataFrame, ends: DataFrame) -> DataFrame:
    """ends: file and index of each chain's home. Aligned chains: id, other, start_word, end_word, other_start, other_end, similarity; and open chains, whose alignment goes
    beyond the words sent along: file, index, other, id, own_file, own_index, places. A task holds one text and one chain."""

    def over(batches):
        import pyarrow as pa

        columns = dict.fromkeys(["id", "other", "start_word", "end_word", "other_start", "other_end"], pa.int64()) | {"similarity": pa.float64()}
        columns |= dict.fromkeys(["file", "index", "own_file", "own_index"], pa.int64()) | {"places": pa.binary()}
        home, at, last, done, mine, out = None, None, None, [], None, []
        for batch in slices(batches, 9):
            for file, index, copy, text, own_file, own_index, start, n, places, sent, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is not None:
                    home, at = word_hashes(text).tolist(), (file, index, copy)
                    continue
                if at != (file, index, copy):
                    raise ValueError("a chain without its home")
                if last != (at, own_file, own_index):
                    last, done, mine = (at, own_file, own_index), [], None
                if sent is not None:
                    mine = word_hashes(sent).tolist()
                if places is None:
                    continue
                line = [(a - start, b, size) for a, b, size in np.frombuffer(places, np.int32).reshape(-1, 3).tolist()]
                if any(all(a <= x + start and x + size + start <= b and c <= y and y + size <= d for x, y, size in line) for a, b, c, d in done):
                    continue  # a passage with this text holds the chain already
                found = segments(mine, home, line)
                if found and (found[0][0] == 0 and start or found[-1][1] == len(mine) and start + len(mine) < n):
                    out.append((own, other, *[None] * 5, file, index, own_file, own_index, places))
                else:
                    for a, b, c, d, same in alike(found):
                        done.append((a + start, b + start, c, d))
                        out.append((own, other, *done[-1], same / max(b - a, d - c), *[None] * 5))
                if len(out) >= 10_000:
                    yield _batch(out, columns)
                    out = []
        if out:
            yield _batch(out, columns)

    hot = stash(ends.groupBy("file", "index").agg(F.ceil(F.count("*") / HOT).cast("int").alias("n")).filter("n > 1"), "hot")
    hot = _small(hot)
    n = F.coalesce("n", F.lit(1))
    empty = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("file", "index", "text").join(hot, ["file", "index"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1))).drop("n")
    chain = chain.join(hot, ["file", "index"], "left").withColumn("copy", F.pmod(F.xxhash64("own_file", "own_index"), n).cast("int")).drop("n")
    longs, blobs = ["own_file", "own_index", "start", "n_words"], ["places", "words"]
    every = texts.select("file", "index", "copy", "text", *(empty("long").alias(c) for c in longs), *(empty("binary").alias(c) for c in blobs), *(empty("long").alias(c) for c in ("id", "other"))).unionByName(
        chain.select("file", "index", "copy", empty("binary").alias("text"), *longs, *blobs, "id", "other")
    )
    by = ["file", "index", "copy"]
    order = every.repartition(*by).sortWithinPartitions(*by, F.col("text").isNull(), "own_file", "own_index", F.col("places").isNotNull(), "start", "places")
    return order.mapInArrow(
        over, "id long, other long, start_word long, end_word long, other_start long, other_end long, similarity double, file long, index long, own_file long, own_index long, places binary"
    )


def again(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Open chains and, for each text and home once, all words of the text; these rows have no places."""
    pair = ["file", "index", "own_file", "own_index"]
    texts = rows.select(F.col("file").alias("own_file"), F.col("index").alias("own_index"), F.col("text").alias("words"))
    whole = texts.join(_small(open_.select(*pair).distinct()), ["own_file", "own_index"])
    zero, empty = F.lit(0).cast("long"), lambda kind: F.lit(None).cast(kind)
    place = [zero.alias("start"), zero.alias("n_words")]
    return whole.select(*pair, empty("long").alias("id"), empty("long").alias("other"), *place, empty("binary").alias("places"), "words").unionByName(
        open_.select(*pair, "id", "other", *place, "places", empty("binary").alias("words"))
    )


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind `passage`: doc_id, start_word, end_word and the passage of other_id they repeat; and of kind `copy`: doc_id,
    whose text is that of other_id, the smallest id that has it. Between copies nothing more is told."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, id_col, text_col)
    digest = stash(rows.select("file", "group", "index", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "digest")
    n_parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), (digest.agg(F.sum("n_bytes")).first()[0] or 0) // PART)
    best = stash(digest.groupBy("sha").agg(F.min(F.struct("id", "file", "index")).alias("best"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "best"), "texts")
    known = stash(digest.join(best, "sha", "left").select("file", "group", "index", "id", "best"), "known")
    lead = F.coalesce((F.col("file") == F.col("best.file")) & (F.col("index") == F.col("best.index")), F.lit(True))
    home = stash(homes(seed_lists(rows, n_parts), n_parts), "homes")
    free(spark)
    chain = stash(chained(rows, home, known.filter(lead)), "chains")
    drop(home)
    free(spark)
    place = ["start_word", "end_word", "other_start", "other_end"]
    first = stash(passages(rows, chain, chain), "passages")
    drop(chain)
    free(spark)
    found = first.filter(F.col("places").isNull())
    open_ = first.filter(F.col("places").isNotNull()).select("file", "index", "other", "id", "own_file", "own_index", "places")
    if not open_.isEmpty():
        open_ = stash(open_, "open")
        wanted = rows.join(_small(open_.select("file", "index").distinct()), ["file", "index"], "left_semi")
        found = found.unionByName(passages(wanted, again(rows, open_), open_))
    found = found.select("id", "other", *place, "similarity").distinct()
    whole = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id" if c == "id" else "other_id")
    copies = known.filter(~lead).select("id", F.col("best.id").alias("other")).select(F.lit("copy").alias("kind"), whole("id"), whole("other"), *(F.lit(None).cast("long").alias(c) for c in place), F.lit(1.0).alias("similarity"))
    return found.select(F.lit("passage").alias("kind"), whole("id"), whole("other"), *place, "similarity").unionByName(copies)


def op8_passages(spark, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
