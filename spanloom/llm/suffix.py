"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A text is a sequence of words between white space. Every passage of `min_tokens` words or more that occurs elsewhere is found by sorting all
suffixes that can have a twin and looking at neighbours with a common prefix of that length; of each passage the first occurrence stays.

1. Which suffixes can have such a neighbour? Every window of min_tokens words has a minimizer, the least hash of its runs of `seed_tokens`
   words; equal windows have equal minimizers. Minimizers are counted over the whole corpus, and only suffixes whose minimizer occurs twice take
   part in the sort. This loses nothing: it is the distinguishing-prefix step of distributed string sorting.
2. Each task sorts its suffixes by their first min_tokens words, as text, and sends a sorted run to each part of the suffixes, by minimizer. A run is
   front-coded: an entry has the length of the prefix that it shares with its predecessor, and where its words stand in the passages sent along, each of
   which is there once for all suffixes that begin in it.
3. Each part merges its runs with a loser tree of strings that keeps, for every loser, its common prefix with the string that beat it: a match
   between different prefix lengths is decided without looking at a byte, and equal lengths are compared beyond it only.
4. Neighbours that share all min_tokens words are one passage; all but the first by (doc_id, hash of id and text, place) are repeats. Repeats of
   consecutive suffixes join to stretches.

Scale: of equal suffixes in one run only the first is sent on; the others can't be first anywhere and leave as joined stretches of their document. The same
holds for minimizers. So a passage that a third of all documents share sends one entry a run to its part, and a part's size follows the number of
different passages. The number of parts follows the counted minimizers, `PART_SEEDS` each. Shuffled are the minimizers (one for about 18 words), the
texts that have a repeated one, and the runs, about 4 words for each suffix before they are compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import apply_arrow, aside, back, cut, grams, map_arrow, mix, named, shuffle_partitions, slices, utf8, whole, words
from .spans import merged, ranks

MIN_TOKENS, SEED_TOKENS, RUN_SUFFIXES, CHUNK_SEEDS, PART_SEEDS = 50, 16, 1 << 17, 1 << 20, 10_000


def minimizers(hashes: np.ndarray, first: np.ndarray, min_tokens: int, seed_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer of the window that starts at each token, whether the window lies within its row, the hash of each seed)."""
    seeds = grams(hashes, seed_tokens)
    width = min_tokens - seed_tokens + 1
    if len(seeds) < width:
        return np.zeros(0, np.uint64), np.zeros(0, bool), seeds
    least, span = seeds, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least, whole(first, min_tokens, len(hashes)), seeds


def _row_key(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(values ^ mix(rows.astype(np.uint64) + np.uint64(1)))


def _identity(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text").where("text IS NOT NULL")


def seeds(docs: DataFrame, min_tokens: int, seed_tokens: int) -> DataFrame:
    """(key, known, seed, rid, n): the minimizers of each document, with n = 2 where it has the seed more than once.

    Of a seed that a chunk of a task meets in several documents one row is as good as all to others: it says so by n = 2. The rest are known to be
    repeated, and are spread by a key of their own.
    """

    def chunk(found: list[tuple]) -> pa.RecordBatch:
        seed, rid, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(seed, kind="stable")
        seed, rid, n = seed[order], rid[order], n[order]
        new = np.append(True, seed[1:] != seed[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(seed)))
        n[new] = np.where(size > 1, 2, n[new])
        key = np.where(new, seed, mix(seed ^ mix(rid.view(np.uint64))))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(~new), pa.array(seed.view(np.int64)), pa.array(rid), pa.array(n.astype(np.int32))], ["key", "known", "seed", "rid", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            rids = batch.column(0).to_numpy()
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs):
                hashes, first, *_ = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], letters=False)
                least, ok, each = minimizers(hashes, first, min_tokens, seed_tokens)
                owner = np.repeat(np.arange(b - a), np.diff(first))
                at = np.flatnonzero(ok)
                keys, index = np.unique(_row_key(least[at], owner[at]), return_index=True)
                if not len(keys):
                    continue
                every, counts = np.unique(_row_key(each, owner[: len(each)]), return_counts=True)
                got = at[index]
                held.append((least[got], rids[owner[got] + a], np.minimum(counts[np.searchsorted(every, keys)], 2)))
                size += len(got)
                if size >= CHUNK_SEEDS:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return map_arrow(docs.select("rid", "text"), run, "key bigint, known boolean, seed bigint, rid bigint, n int")


def repeated_seeds(found: DataFrame) -> DataFrame:
    """(rid, seeds): of each document, the minimizers that occur twice in the corpus. Neighbours in the sorted order tell, so no group is held."""
    order = Window.partitionBy("key", "known").orderBy("rid")
    other = F.col("known") | (F.col("n") > 1) | F.lag("key").over(order).isNotNull() | F.lead("key").over(order).isNotNull()
    return found.withColumn("other", other).where("other").groupBy("rid").agg(F.collect_set("seed").alias("seeds"))


# --- sorted runs ---


def shared_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which `known` bytes are known to be common. Mostly the next few bytes differ; their first difference is
    found by an exclusive or of both as numbers."""
    a, b = x[known : known + 16], y[known : known + 16]
    if a != b:
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        return known + n - (differ.bit_length() + 7) // 8
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    low, high = known + 16, n  # x[:low] is common, x[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        if x[known:mid] == y[known:mid]:
            known = low = mid
        else:
            high = mid
    return low


def pack(passages: list[bytes], where: np.ndarray, nth: np.ndarray, shared: np.ndarray) -> bytes:
    """A front-coded run: entry k begins with word nth[k] of passages[where[k]], and shares shared[k] bytes with entry k - 1."""
    lengths = np.array([len(x) for x in passages], np.uint32)
    arrays = [lengths, where.astype(np.uint32), nth.astype(np.uint32), shared.astype(np.uint32)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<2Q", len(passages), len(where)) + b"".join(x.tobytes() for x in arrays) + b"".join(passages))


def unpack(blob: bytes, min_tokens: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """(entries of min_tokens words, shared prefixes, where, nth) of a run."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n_passages, n = struct.unpack_from("<2Q", raw)
    at = 16

    def take(count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, np.uint32, count, at).astype(np.int64)
        at += 4 * count
        return out

    lengths, where, nth, shared = take(n_passages), take(n), take(n), take(n)
    text = np.frombuffer(raw, np.uint8, offset=at)
    word = np.append(0, np.flatnonzero(text == 32) + 1)  # where words begin; a blank ends each
    first = np.searchsorted(word, np.concatenate([[0], np.cumsum(lengths)]))[where] + nth
    return [raw[i:j] for i, j in zip((at + word[first]).tolist(), (at + word[first + min_tokens]).tolist())], shared.tolist(), where, nth


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> list[list[int]]:
    """For each string of each sorted run, the number of its group of equal strings in the merged order.

    shared[r][i] is the length of the common prefix of runs[r][i] and its predecessor. A loser keeps its common prefix with the string that
    beat it, which is the last string put out when its turn comes; so no byte of a known common prefix is looked at again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r) for r in runs] + [0] * (k - len(runs))
    at = [0] * k
    prefix = [0] * k  # with the last string put out
    text: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    losers = [0] * k
    groups: list[list[int]] = [[0] * len(r) for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        p = shared_prefix(x, y, p)
        if x[p : p + 1] <= y[p : p + 1]:
            prefix[b] = p
            return a, b
        prefix[a] = p
        return b, a

    winners = list(range(k))
    width = k
    while width > 1:
        width //= 2
        now = []
        for j in range(width):
            win, lose = play(winners[2 * j], winners[2 * j + 1])
            losers[width + j] = lose
            now.append(win)
        winners = now
    win, group, begun, length = winners[0], -1, False, 0
    while text[win] is not None:
        if not begun or prefix[win] < len(text[win]) or len(text[win]) != length:
            group, begun, length = group + 1, True, len(text[win])
        i = at[win]
        groups[win][i] = group
        i += 1
        at[win] = i
        if i < ends[win]:
            text[win], prefix[win] = runs[win][i], shared[win][i]
        else:
            text[win] = None
        node = (win + k) >> 1
        while node:
            other = losers[node]
            x, y = text[win], text[other]
            if y is not None:
                if x is None:
                    losers[node], win = win, other
                else:
                    p, q = prefix[win], prefix[other]
                    if p < q:
                        losers[node], win = win, other
                    elif p == q:
                        p = shared_prefix(x, y, p)
                        if x[p : p + 1] <= y[p : p + 1]:
                            prefix[other] = p
                        else:
                            prefix[win] = p
                            losers[node], win = win, other
            node >>= 1
    return groups


def _spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with a blank after each, and where each begins."""
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[step + np.repeat(begin, sizes)] = buf[step + np.repeat(starts, sizes)]
    return out.tobytes(), np.append(begin, len(out))


RUN = "part bigint, run binary, docs array<{kind}>, rids array<bigint>, at array<bigint>, upto array<bigint>"


def _runs(docs: DataFrame, min_tokens: int, seed_tokens: int, parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes whose minimizer is repeated, with the document of each passage and the place of its first word; and,
    without a run, stretches of words that are known to repeat something."""
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def row(part: int, run: bytes | None, ids: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        lists = [one(ids.cast(id_type), id_type), *[one(pa.array(x.astype(np.int64)), pa.int64()) for x in numbers]]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([run], pa.binary()), *lists], ["part", "run", "docs", "rids", "at", "upto"])

    def sort(texts: list[bytes], least: np.ndarray, owner: np.ndarray, place: np.ndarray, where: np.ndarray, nth: np.ndarray, passages: list[bytes], ids: pa.Array, rids: np.ndarray) -> Iterator[pa.RecordBatch]:
        rank = ranks(ids, rids)[owner]
        order = np.lexsort((place, rank))
        order = np.array(sorted(order.tolist(), key=texts.__getitem__))  # stable: of equal texts the first comes first
        strings = [texts[i] for i in order.tolist()]
        new = np.array([True, *(x != y for x, y in zip(strings[1:], strings))])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        late = order[~new & ((rank[order] != rank[head]) | (place[order] != place[head]))]
        if len(late):
            who, at, upto = merged(owner[late], place[late], place[late] + min_tokens)
            yield row(int(rids[who[0]]) % parts, None, ids.take(pa.array(who)), rids[who], at, upto)
        first = order[new]
        part = (mix(least[first]) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(part[by]) > 0))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(by)]):
            own = first[by[a:b]]
            strings = [texts[i] for i in own.tolist()]
            shared = np.array([0, *(shared_prefix(x, y) for x, y in zip(strings, strings[1:]))])
            used, here = np.unique(where[own], return_inverse=True)
            some = np.zeros(len(used), np.int64)
            some[here] = own  # an entry of each passage
            blob = pack([passages[i] for i in used.tolist()], here, nth[own], shared)
            yield row(int(part[by[a]]), blob, ids.take(pa.array(owner[some])), rids[owner[some]], place[some] - nth[some], np.zeros(0))

    def run(batches):
        held: list[tuple] = []
        texts: list[bytes] = []
        passages: list[bytes] = []
        ids, rids, n_rows = [], [], 0

        def flush():
            least, owner, place, where, nth = (np.concatenate([h[k] for h in held]) for k in range(5))
            yield from sort(texts, least, owner, place, where, nth, passages, pa.chunked_array(ids).combine_chunks(), np.concatenate(rids))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            rids.append(batch.column(1).to_numpy())
            buf, offs = utf8(batch.column(2))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy().view(np.uint64)
            per = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            for a, b in slices(offs):
                hashes, first, starts, ends = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], letters=False)
                least, ok, _ = minimizers(hashes, first, min_tokens, seed_tokens)
                owner = np.repeat(np.arange(a, b), np.diff(first))
                mine = (per >= a) & (per < b)
                known = np.sort(_row_key(flat[mine], per[mine]))
                at = np.flatnonzero(ok)
                key = _row_key(least[at], owner[at])
                near = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                at = at[known[near] == key] if len(known) else at[:0]
                if not len(at):
                    continue
                spelled, begin = _spelled(buf[offs[a] : offs[b]], starts, ends)
                last = at + min_tokens
                # A passage is a stretch of suffixes that follow one another under one minimizer.
                fresh = np.append(True, (np.diff(at) > 1) | (least[at][1:] != least[at][:-1]) | (owner[at][1:] != owner[at][:-1]))
                number = np.cumsum(fresh) - 1
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(at)) - 1
                base = len(passages)
                passages += [spelled[i:j] for i, j in zip(begin[at[heads]].tolist(), begin[last[tails]].tolist())]
                texts += [spelled[i:j] for i, j in zip(begin[at].tolist(), begin[last].tolist())]
                mine = owner[at]
                held.append((least[at], mine + n_rows, at - first[mine - a], base + number, at - at[heads][number]))
                if len(texts) >= RUN_SUFFIXES:
                    yield from flush()
                    held, texts, passages = [], [], []
            n_rows += batch.num_rows
            if not held:
                ids, rids, n_rows = [], [], 0
        if held:
            yield from flush()

    return map_arrow(docs.select("doc_id", "rid", "text", "seeds"), run, RUN.format(kind=kind.simpleString()))


def _later(table: pa.Table, min_tokens: int) -> pa.Table:
    """(doc_id, rid, at, upto) of the repeated stretches of a part."""
    table = table.combine_chunks()
    run = table.column("run").to_pylist()
    lists = {c: table.column(c).combine_chunks() for c in ("docs", "rids", "at", "upto")}
    offs = np.asarray(lists["rids"].offsets)
    doc, rid, at, upto = lists["docs"].flatten(), *(lists[c].flatten().to_numpy() for c in ("rids", "at", "upto"))
    offs = offs - offs[0]
    found = [(np.arange(offs[k], offs[k + 1]), at[offs[k] : offs[k + 1]]) for k, r in enumerate(run) if r is None]
    who, begin = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    end = upto  # known stretches are the only ones that say where they end
    if any(r is not None for r in run):
        texts, shares, owner, place = [], [], [], []
        for k, r in enumerate(run):
            if r is not None:
                entries, shared, where, nth = unpack(r, min_tokens)
                texts.append(entries)
                shares.append(shared)
                owner.append(offs[k] + where)
                place.append(at[offs[k] + where] + nth)
        group = np.concatenate([np.array(g, np.int64) for g in merge(texts, shares)])
        owner, place = np.concatenate(owner), np.concatenate(place)
        rank = ranks(doc, rid)[owner]
        order = np.lexsort((place, rank, group))
        head = order[np.maximum.accumulate(np.where(np.append(True, np.diff(group[order]) > 0), np.arange(len(order)), 0))]
        late = order[(rank[order] != rank[head]) | (place[order] != place[head])]
        some = np.zeros(int(rank.max()) + 1, np.int64)
        some[rank] = owner
        stretch, a, b = merged(rank[late], place[late], place[late] + min_tokens)
        who, begin, end = np.concatenate([who, some[stretch]]), np.concatenate([begin, a]), np.concatenate([end, b])
    return pa.table([doc.take(pa.array(who)), pa.array(rid[who]), pa.array(begin), pa.array(end)], ["doc_id", "rid", "at", "upto"])


def spans(docs: DataFrame, min_tokens: int = MIN_TOKENS, seed_tokens: int = SEED_TOKENS) -> DataFrame:
    """(doc_id, rid, at, upto): every stretch of words that repeats an earlier passage; those of a document don't touch."""
    rows = _identity(docs)
    twice = cut(repeated_seeds(seeds(rows, min_tokens, seed_tokens)))
    n = twice.agg(F.sum(F.size("seeds"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-n // PART_SEEDS))
    runs = _runs(rows.join(twice, "rid"), min_tokens, seed_tokens, parts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = apply_arrow(runs.groupBy("part"), lambda table: _later(table, min_tokens), f"doc_id {kind}, rid bigint, at bigint, upto bigint")
    order = Window.partitionBy("doc_id", "rid").orderBy("at", "upto")
    reach = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(order)
    joined = pieces.withColumn("reach", reach).withColumn("island", island)
    return joined.groupBy("doc_id", "rid", "island").agg(F.min("at").alias("at"), F.max("upto").alias("upto")).drop("island")


def repeats(docs: DataFrame, min_tokens: int = MIN_TOKENS, seed_tokens: int = SEED_TOKENS) -> DataFrame:
    """(doc_id, start, end, n_tokens): the spans, in words, of each document that repeat an earlier passage.

    Earlier is by doc_id, nulls last, then by a hash of id and text, then by place; a passage that one document has twice is repeated too. Rows that
    repeat id and text are one document. Texts of fewer than min_tokens words, null and empty ones have no spans. An empty table gives no rows.
    Other columns are not read.
    """
    found = spans(docs, min_tokens, seed_tokens)
    return found.select("doc_id", F.col("at").alias("start"), F.col("upto").alias("end"), (F.col("upto") - F.col("at")).alias("n_tokens"))


def deduplicate(docs: DataFrame, min_tokens: int = MIN_TOKENS, seed_tokens: int = SEED_TOKENS) -> DataFrame:
    """docs, all rows and columns, each text without the spans of repeats(). White space around a span stays."""
    found = spans(docs.select("doc_id", "text"), min_tokens, seed_tokens)
    cuts = found.groupBy(F.col("doc_id").alias("d"), "rid").agg(F.array_sort(F.collect_list(F.struct("at", "upto"))).alias("cut"))
    doc, name = F.col(named(docs, "doc_id")), named(docs, "text")
    out = aside(docs).join(cuts, doc.eqNullSafe(F.col("d")) & (F.xxhash64(doc, name) == F.col("rid")), "left").drop("d", "rid")
    own = [f"__c{k}" for k in range(len(docs.columns))]

    def shorten(batches):
        for batch in batches:
            text, gone = batch.column(batch.schema.get_field_index(name)), batch.column(batch.schema.get_field_index("cut")).to_pylist()
            said = []
            for k, stretches in enumerate(gone):
                raw = text[k].as_py()
                if stretches:
                    data = raw.encode()
                    _, _, starts, ends = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), letters=False)
                    edges = [0, *(x for s in stretches for x in (int(starts[s["at"]]), int(ends[s["upto"] - 1]))), len(data)]
                    raw = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])).decode()
                said.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()) if c == name else batch.column(batch.schema.get_field_index(c)) for c in own], own)

    return back(map_arrow(out, shorten, out.select(*own).schema), docs)
