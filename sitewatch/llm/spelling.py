"""Spelling variants: words one edit apart, found by a trie over letter-group counts.

Letters fall into LEVELS groups (code point modulo LEVELS). A word's path in the trie is its count of each
group in turn, counts above 14 taken as 15. One inserted, deleted or replaced code point changes at most
one count by +1 and one by -1, so a depth-first search that may spend one surplus and one deficit meets every
near word's leaf; the words there are then verified letter by letter.

The trie's top is opened until a subtree holds at most CELL words, and a subtree is a unit of work: words go to
their own one, and as a query to those that the search from the root comes to. Only the opened nodes are
collected and sent to tasks, OPENED at most, for CELL grows with the words beyond that. Queries of a subtree
are dealt into chunks that each get the subtree's words. A leaf of more than CELL words of the same counts is
opened by one more level, the word without one of its letters: two near words share exactly one such rest
(or one is the other's rest), and few words can share one.

A null text has no words; a null doc_id counts as no digits; repeated rows count anew; other columns are
ignored; without words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, saved, utf8

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, RAREST, DAMAGE = 5, 3, 97
LEVELS, TOP_COUNT = 16, 15
#: Words of a subtree; opened nodes of the trie's top at most; queries of a chunk, by words of a subtree.
CELL, OPENED, QUERIES = 4096, 1 << 17, 8
#: Steps of the search, pairs, pairs to verify, and rows, that a task holds at once.
STEPS, PAIRS, VERIFIED, ROWS = 1 << 15, 1 << 16, 1 << 13, 1 << 16
#: Leaves of a subtree that the search doesn't open any more.
FEW = 4
#: Longer words are verified one by one.
WIDE = 64


def damaged(run: str, doc_id: str) -> Column:
    """The run without one code point, where the checksum of document and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(run)), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(F.col(run))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): the words of the texts with at least SHORTEST code points and RAREST occurrences."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    return runs.select(damaged("run", "doc_id").alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each letter of a column of words, and where each word begins. All letters are below U+0100,
    so in UTF-8 the byte C3 says that the next letter is 64 higher."""
    raw, offsets = utf8(column)
    lead = raw == 0xC3
    after = np.zeros(len(raw), np.uint8)
    after[1:] = lead[:-1] * np.uint8(0x40)
    places = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~lead, out=places[1:])
    return (raw + after)[~lead], places[offsets]


def text(letters: np.ndarray) -> str:
    return letters.tobytes().decode("latin-1")


def codes(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A word's path: four bits for each group's count, the first group highest."""
    n = len(offsets) - 1
    counts = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * LEVELS + letters % LEVELS, minlength=n * LEVELS).reshape(n, LEVELS)
    out = np.zeros(n, np.uint64)
    for level in range(LEVELS):
        out = (out << np.uint64(4)) | np.minimum(counts[:, level], TOP_COUNT).astype(np.uint64)
    return out


def prefix(code: np.ndarray, level: int) -> np.ndarray:
    """The path down to a level, the rest zero."""
    return code & np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 4 * level)) - 1) if level else 0)


def count_at(code: np.ndarray, level: int) -> np.ndarray:
    return ((code >> np.uint64(60 - 4 * level)) & np.uint64(15)).astype(np.int64)


def with_codes(words: DataFrame) -> DataFrame:
    """words (word, n) with `code`, as a long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(codes(*latin(batch.column("word"))).view(np.int64))], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(lean(run), "word string, n long, code long")


def opened(words: DataFrame, cell: int) -> list[np.ndarray]:
    """The paths of each level's nodes (0 to LEVELS) that hold more than `cell` words, sorted. Of a level's nodes
    fewer than words / cell are, and cell() keeps all of them within OPENED."""
    alike = words.groupBy("code").agg(F.count("*").alias("n"))
    masks = F.array(*[F.lit(((1 << 64) - 1 ^ (1 << (64 - 4 * k)) - 1) - (1 << 64) if k else 0).cast("long") for k in range(LEVELS + 1)])
    nodes = alike.select("n", F.posexplode(F.transform(masks, lambda m: F.col("code").bitwiseAND(m))).alias("level", "path"))
    full = nodes.groupBy("level", "path").agg(F.sum("n").alias("n")).where(F.col("n") > cell).select("level", "path").collect()
    out: list[list[int]] = [[] for _ in range(LEVELS + 1)]
    for row in full:
        out[row["level"]].append(row["path"])
    return [np.sort(np.array(x, np.int64).view(np.uint64)) for x in out]


def cell_size(n: int) -> int:
    """Words of a subtree, so that no more than OPENED nodes can hold more."""
    return max(CELL, -(-n * (LEVELS + 1) // OPENED))


def among(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    if not len(full):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(full, values), len(full) - 1)
    return full[at] == values


def spend(code: np.ndarray, level: int, up: np.ndarray, down: np.ndarray):
    """The children that a search may go on to: (rows, count, surplus left, deficit left) for the word's own
    count, one more for the surplus, one less for the deficit, which is there once the surplus is spent."""
    c, rows = count_at(code, level), np.arange(len(code))
    more, less = np.flatnonzero(up & (c < TOP_COUNT)), np.flatnonzero(down & (c > 0))
    all_ = lambda x, yes: np.full(len(x), yes)
    return (rows, c, up, down), (more, c[more] + 1, all_(more, False), all_(more, True)), (less, c[less] - 1, all_(less, False), all_(less, False))


def visited(code: np.ndarray, tops: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(rows, level, path, left) of the unopened nodes, and of opened leaves, that the words' searches from the root
    come to, with what is left to spend there (1 surplus, 2 deficit); depth first, STEPS at a time."""
    n = len(code)
    stack = [(0, np.arange(n), np.zeros(n, np.uint64), np.ones(n, bool), np.zeros(n, bool))]
    while stack:
        level, rows, path, up, down = stack.pop()
        if len(rows) > STEPS:
            half = len(rows) // 2
            stack += [(level, *(x[half:] for x in (rows, path, up, down))), (level, *(x[:half] for x in (rows, path, up, down)))]
            continue
        shut = ~among(path, tops[level]) if level < LEVELS else np.ones(len(rows), bool)
        if shut.any():
            yield rows[shut], level, path[shut], (up + 2 * down)[shut].astype(np.int32)
        go = np.flatnonzero(~shut)
        if len(go):
            for at, count, u, d in spend(code[rows[go]], level, up[go], down[go]):
                if len(at):
                    stack.append((level + 1, rows[go][at], path[go][at] | (count.astype(np.uint64) << np.uint64(60 - 4 * level)), u, d))


def rests(word: str) -> list[str]:
    """The word, and what is left of it without one of its letters; each once."""
    return list({word} | {word[:i] + word[i + 1 :] for i in range(len(word))})


#: spend is what a query has left, or OWN for a word in its own subtree.
OWN = -1
ROUTED = "level int, path long, rest string, spend int, word string, n long, code long"


def routed(words: DataFrame, tops: list[np.ndarray]) -> DataFrame:
    """Each word at its own subtree, and as a query at every one that its search comes to."""

    def rows(batch: pa.RecordBatch, left: np.ndarray, at: np.ndarray, level: int, path: np.ndarray) -> Iterator[pa.RecordBatch]:
        hot = among(path, tops[level])  # only a leaf can be here though it is opened
        for some, open_ in ((np.flatnonzero(~hot), False), (np.flatnonzero(hot), True)):
            for i in range(0, len(some), ROWS if not open_ else 1024):
                part = some[i : i + (ROWS if not open_ else 1024)]
                rest, take = pa.array([""] * len(part)), np.arange(len(part))
                if open_:
                    each = [rests(w) for w in batch.column("word").take(pa.array(at[part])).to_pylist()]
                    rest, take = pa.array([r for x in each for r in x]), np.repeat(take, [len(x) for x in each])
                part = part[take]
                cols = batch.take(pa.array(at[part]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), level, np.int32)), pa.array(path[part].view(np.int64)), rest, pa.array(left[part]), *(cols.column(c) for c in ("word", "n", "code"))], names=["level", "path", "rest", "spend", "word", "n", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.asarray(batch.column("code").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            left = np.arange(len(code))
            for level in range(LEVELS + 1):
                path = prefix(code[left], level)
                stays = ~among(path, tops[level]) if level < LEVELS else np.ones(len(left), bool)
                yield from rows(batch, np.full(int(stays.sum()), OWN, np.int32), left[stays], level, path[stays])
                left = left[~stays]
            for at, level, path, spare in visited(code, tops):
                yield from rows(batch, spare, at, level, path)

    return words.mapInArrow(lean(run), ROUTED)


def matches(cells: np.ndarray, code: np.ndarray, depth: np.ndarray, q_cells: np.ndarray, q_code: np.ndarray, q_spend: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, first leaf, past the last) of the leaves that the search comes to. cells, code, depth: of the leaves,
    sorted by cell and code, each once, and the level of the cell's own node; a query starts there."""
    if not len(code) or not len(q_code):
        return
    node = np.zeros(len(code), np.int64)
    node[1:] = np.cumsum(cells[1:] != cells[:-1])
    begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    keys, spans, at_level = [], [], [node]  # of each level's nodes: parent and count that lead to them; their leaves
    for level in range(LEVELS):
        key = node * (TOP_COUNT + 1) + count_at(code, level)
        change = np.r_[True, key[1:] != key[:-1]]
        keys.append(key[change])
        node = np.cumsum(change) - 1
        at_level.append(node)
    for of in at_level:
        spans.append(np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(code)])
    root = np.minimum(np.searchsorted(cells[begin], q_cells), len(begin) - 1)
    there = np.flatnonzero(cells[begin][root] == q_cells)
    leaf = begin[root[there]]
    stack = []
    for level in np.unique(depth[leaf]):
        some = there[depth[leaf] == level]
        stack.append((int(level), some, at_level[level][begin[root[some]]], (q_spend[some] & 1) > 0, (q_spend[some] & 2) > 0))
    while stack:
        level, rows, at, up, down = stack.pop()
        first, past = spans[level][at], spans[level][at + 1]
        end = past - first <= (FEW if level < LEVELS else 1 << 62)
        if end.any():
            yield rows[end], first[end], past[end]
            rows, at, up, down = (x[~end] for x in (rows, at, up, down))
        if len(rows) > STEPS:
            half = len(rows) // 2
            stack += [(level, *(x[half:] for x in (rows, at, up, down))), (level, *(x[:half] for x in (rows, at, up, down)))]
            continue
        if not len(rows):
            continue
        for go, count, u, d in spend(q_code[rows], level, up, down):
            key = at[go] * (TOP_COUNT + 1) + count
            place = np.minimum(np.searchsorted(keys[level], key), len(keys[level]) - 1)
            found = keys[level][place] == key
            if found.any():
                stack.append((level + 1, rows[go[found]], place[found], u[found], d[found]))


def ends_of(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's first two letters and its last three, each as a number. An edit leaves one of both as it is, in
    words of five letters or more; of shorter words these numbers are all 0."""
    head, tail = np.zeros(len(offsets) - 1, np.int32), np.zeros(len(offsets) - 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= 5)
    for i in range(2):
        head[long] = head[long] << 8 | letters[offsets[long] + i]
    for i in range(3):
        tail[long] = tail[long] << 8 | letters[offsets[long + 1] - 3 + i]
    return head, tail


def squares(letters: np.ndarray, offsets: np.ndarray, which: np.ndarray, width: int, right: bool, fill: int) -> np.ndarray:
    """The letters of some words as rows of a matrix, set to the left or to the right."""
    begin = offsets[which].astype(np.int64)
    size = offsets[which + 1] - begin
    at = np.arange(width)[None, :] - (width - size if right else 0 * size)[:, None]
    outside = (at < 0) | (at >= size[:, None])
    at += begin[:, None]
    at[outside] = 0
    found = letters[at]
    found[outside] = fill
    return found


def near(letters: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by exactly one inserted, deleted or replaced letter: what they share from
    the left and from the right, together, is all but one letter of the longer."""
    size = np.diff(offsets)
    out = np.zeros(len(a), bool)
    fit = np.flatnonzero(np.abs(size[a] - size[b]) <= 1)
    wide = np.maximum(size[a[fit]], size[b[fit]])
    for i in fit[wide > WIDE]:
        out[i] = one_edit(text(letters[offsets[a[i]] : offsets[a[i] + 1]]), text(letters[offsets[b[i]] : offsets[b[i] + 1]]))
    fit = fit[wide <= WIDE]
    if len(fit):
        width, shared = int(max(size[a[fit]].max(), size[b[fit]].max())), 0
        for right in (False, True):
            other = squares(letters, offsets, a[fit], width, right, 1) != squares(letters, offsets, b[fit], width, right, 2)
            if right:
                other = other[:, ::-1]
            shared = shared + np.where(other.any(1), other.argmax(1), width)
        x, y = size[a[fit]], size[b[fit]]
        out[fit] = np.where(x == y, shared == x - 1, shared >= np.minimum(x, y))
    return out


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


FOUND = "word string, near long, form string, form_n long"


def searched(cells: np.ndarray, depth: np.ndarray, spare: np.ndarray, column: pa.Array, n: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Of each word of some whole cells: how many near words were found for it, and the one of largest n."""
    letters, offsets = latin(column)
    size, (head, tail) = np.diff(offsets), ends_of(letters, offsets)
    own, qs = np.flatnonzero(spare == OWN), np.flatnonzero(spare != OWN)
    own = own[np.lexsort((code[own], cells[own]))]
    first = np.flatnonzero(np.r_[True, (cells[own][1:] != cells[own][:-1]) | (code[own][1:] != code[own][:-1])]) if len(own) else np.zeros(0, np.int64)
    starts = np.r_[first, len(own)]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, leaf, past in matches(cells[own[first]], code[own[first]], depth[own[first]], cells[qs], code[qs], spare[qs]):
        low, k = starts[leaf], starts[past] - starts[leaf]
        ends = np.cumsum(k)
        i = 0
        while i < len(rows):  # so many pairs at once
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            m = k[i:j]
            d = own[np.repeat(low[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            q = np.repeat(qs[rows[i:j]], m)
            may = ((head[q] == head[d]) | (tail[q] == tail[d])) & (np.abs(size[q] - size[d]) <= 1) & (code[q] <= code[d])
            q, d = q[may], d[may]
            for v in range(0, len(q), VERIFIED):
                yes = near(letters, offsets, q[v : v + VERIFIED], d[v : v + VERIFIED])
                links.append((q[v : v + VERIFIED][yes], d[v : v + VERIFIED][yes]))
            i = j
    q, d = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    back = code[q] != code[d]
    q, d = np.concatenate([q, d[back]]), np.concatenate([d, q[back]])
    if not len(q):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["word", "near", "form", "form_n"])
    words = column.to_pylist()
    rank = np.zeros(len(words), np.int64)
    of = np.unique(d)
    rank[of[sorted(range(len(of)), key=lambda i: words[of[i]])]] = np.arange(len(of))
    order = np.lexsort((rank[d], -n[d], q))
    q, d = q[order], d[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return pa.RecordBatch.from_arrays([column.take(pa.array(q[start])), pa.array(np.diff(np.r_[start, len(q)])), column.take(pa.array(d[start])), pa.array(n[d[start]])], names=["word", "near", "form", "form_n"])


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """searched() over rows sorted by (level, path, rest, chunk), whole cells at a time."""
    held: list[pa.RecordBatch] = []

    def cells_of(t: pa.Table) -> np.ndarray:
        level, path, chunk = (t.column(c).to_numpy() for c in ("level", "path", "chunk"))
        rest = t.column("rest").combine_chunks()
        rest = (rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest).dictionary_encode().indices.to_numpy()
        new = (level[1:] != level[:-1]) | (path[1:] != path[:-1]) | (chunk[1:] != chunk[:-1]) | (rest[1:] != rest[:-1])
        return np.r_[0, np.cumsum(new)]

    def done(t: pa.Table, cells: np.ndarray) -> pa.RecordBatch:
        word = t.column("word").combine_chunks()
        word = word.chunk(0) if isinstance(word, pa.ChunkedArray) else word
        return searched(cells, t.column("level").to_numpy(), t.column("spend").to_numpy(), word, t.column("n").to_numpy(), t.column("code").to_numpy().view(np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            t = pa.Table.from_batches(held)
            cells = cells_of(t)
            cut = int(np.searchsorted(cells, cells[-1]))
            if cut:
                yield done(t.slice(0, cut), cells[:cut])
                held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield done(t, cells_of(t))


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n; each once) with n_near, and the near word of largest n (least, of several): best, best_n."""
    words = saved(with_codes(words), "words")
    cell = cell_size(words.count())
    at = saved(routed(words, opened(words, cell)), "routed")
    asked = at.groupBy("level", "path", "rest").agg(F.count_if(F.col("spend") != OWN).alias("q"), F.count_if(F.col("spend") == OWN).alias("d")).where("d > 0")
    asked = asked.select(F.col("level").alias("_l"), F.col("path").alias("_p"), F.col("rest").alias("_r"), F.greatest(F.ceil(F.col("q") / (QUERIES * cell)), F.lit(1)).cast("int").alias("chunks"))
    dealt = at.join(asked, (F.col("level") == F.col("_l")) & (F.col("path") == F.col("_p")) & (F.col("rest") == F.col("_r"))).drop("_l", "_p", "_r")
    one = F.array(F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("spend") != OWN, one).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))).drop("chunks")
    place = ["level", "path", "rest", "chunk"]
    found = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(lean(search), FOUND)
    best = found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("x"))
    best = best.select(F.col("word").alias("_w"), "near", F.col("x.form").alias("best"), (-F.col("x.m")).alias("best_n"))
    return words.join(best, F.col("word") == F.col("_w"), "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), "best", "best_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): from a word by its forms to the last. Every round doubles the steps
    taken; n at least doubles with each form, so there are few."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = now.select(F.col("word").alias("_w"), F.col("root").alias("_to"))
        old, now = now, saved(now.join(jump, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").limit(1).isEmpty()
        now_at, now = now.saved_at, now.drop("moved")
        now.saved_at = now_at
        discard(old)
        if not moved:
            return now


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    near_ = near_words(vocabulary(documents))
    enough = F.col("best_n") >= 2 * F.col("n")
    named = saved(near_.select("word", "n", "n_near", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    root = roots(named.where("form IS NOT NULL")).select(F.col("word").alias("_w"), "root")
    return named.join(root, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
