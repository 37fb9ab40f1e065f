"""Each operator against brute force, an exact round trip or held-out accuracy, on small tables with
nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import chat, common, jaccard_join, mixing, neighbours, pieces, piecewise, suffix_dedup, token_files, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bucket int, target double, node long"


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def texts():
    r = random.Random(5)
    base, passage = prose(r, 150), prose(r, 60)
    out = [None, "", "   \n", "a", "One two", "one TWO", "🙂 é日本 " * 3, "x" * 700, "ab" * 900, base, base]
    for i in range(12):
        words = base.split()
        for j in range(i):
            words[(j * 11 + i) % len(words)] = f"new{i}x{j}"
        out.append(" ".join(words))
    out += [f"{prose(r, 30)} {passage} {prose(r, 30)}" for _ in range(6)]
    out += [prose(r, n) for n in (4, 5, 6, 80, 3000)]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i * 3, x) for i, x in enumerate(t)]
    return out + [(9, t[9]), (None, "no id " * 60), (27, t[9])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    sources = ["s2", "s10", None, "s1"]
    full = [(i, t, "en", sources[k % 4], 0, 1, "k", 2, 1.0, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3).cache()


def utf(t):
    return (t or "").encode()


def test_suffix_dedup(spark, docs, rows, monkeypatch):
    count = collections.Counter(b[i : i + 200] for _, t in rows for b in [utf(t)] for i in range(len(b) - 199))
    want = []
    for i, t in rows:
        b = utf(t)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((str(i), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for crowded in (2000, 0):  # every mixed bucket is dealt anew in the second run
        monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
        assert sorted((str(r[0]), *r[1:]) for r in suffix_dedup.deduplicated(docs).collect()) == sorted(want)
    assert suffix_dedup.deduplicated(docs.where("false")).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_difference_cover():
    for v in (7, 32, 64):
        c = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v)) and len(c) < v / 2


def test_toxicity_learns_every_insult(spark):
    """Texts hold several insults each; every one is learned, and words beside them are not."""
    r = random.Random(11)
    bad = ["scumbag", "dimwit", "loathsome", "buffoon", "halfwit", "cretin"]
    data = []
    for i in range(600):
        words, toxic = prose(r, 30).split(), i % 4 == 0
        for w in r.sample(bad, 3) if toxic else []:
            words[r.randrange(30)] = w
        data.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (model.scores(pa.array(bad)) >= toxicity.THRESHOLD).all()
    assert (model.scores(pa.array([f"{prose(r, 5)} {w}, {prose(r, 5)}" for w in bad])) >= toxicity.THRESHOLD).all()
    assert model.scores(pa.array([prose(r, 500)]))[0] < toxicity.THRESHOLD


def test_sketch_of_shingles(spark, monkeypatch):
    """Classes follow the counts, whatever the tasks; the number of counters grows with the texts."""
    monkeypatch.setattr(jaccard_join, "FEWEST", 1 << 12)
    texts = [f"common words that all have w{i % 3} x{i} y{i} z{i} a{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as key").repartition(5)
    counters = jaccard_join.counters_for(docs)
    assert counters == 1 << 12 and jaccard_join.counters_for(docs.where("false")) == 1 << 12
    classes = jaccard_join.frequency_classes(jaccard_join.measured(docs, counters).where("slice is not null").select("slice", "counts"), counters)
    total = np.zeros(counters, np.int64)
    sets = [jaccard_join.shingle_sets(*common.utf8(pa.array([t])))[0] for t in texts]
    for s in sets:
        np.add.at(total, (s % np.uint64(counters)).astype(np.int64), 1)
    for s in sets:
        log = [int(total[int(x) % counters]).bit_length() for x in s]
        assert jaccard_join.ranks(classes, s).tolist() == [x if x <= 8 else 8 + (x - 8) // 2 for x in log]


def test_toxicity(spark):
    r = random.Random(3)
    bad = ["scumbag", "dimwit", "loathsome"]
    data = []
    for i in range(600):
        words, toxic = prose(r, 40).split(), i % 3 == 0
        if toxic:
            words[r.randrange(40)] = r.choice(bad)
        data.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in data] + [(None, None, "x", 1.0), (9000, "", "x", 1.0), (9001, "you d.i.m.w.i.t there", "x", 1.0), (9002, "you d i m w i t there", "x", 1.0), (9003, "such a dimxwit now", "x", 1.0), (9004, "a dxxixxmxxwxxixxt", "x", 1.0), (9005, prose(r, 20000) + " scumbag", "x", 1.0), (9006, prose(r, 20000), "x", 1.0), (9007, "y" * 5000, "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in data] + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _, _ in data)
    assert np.mean([got[i]["predicted"] == y for i, _, y in data if i in set(held)]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[None]["predicted"] == got[9000]["predicted"] == 0
    assert [got[i]["predicted"] for i in range(9001, 9008)] == [1, 1, 1, 1, 1, 0, 0]
    assert toxicity.scored(docs, toxicity.fit(docs, labels.where("toxic = 0"))).agg({"score": "max"}).first()[0] == 0
    assert toxicity.scored(docs.where("false"), None).count() == 0


def brute_kernel(s, t):
    from itertools import combinations

    weigh = lambda x: [("".join(x[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(x)), toxicity.ORDER)]
    return sum(a * b for u, a in weigh(s) for v, b in weigh(t) if u == v)


def test_kernel_is_the_gap_weighted_one():
    units = ["idiot", "idxiot", "i..d..i..o..t", "ixxdxxixxoxxt", "mroon", "aaaa", "zzz", "", "a", "ab", "straße", "\U0001f642idiot"]
    landmarks = ["^idiot", "idio", "^moron", "aaa"]
    model = toxicity.Model(landmarks, np.array([1.0, -0.5, 2.0, 0.25]), 0.1, 1.0, 0.0)
    want = np.array([[brute_kernel(u, t) / max(1e-30, brute_kernel(u, u) * brute_kernel(t, t)) ** 0.5 for t in landmarks] for u in ("^" + x for x in units)])
    assert np.abs(model.kernel(units) - want).max() < 1e-5 and want[2, 0] > 0.02 and want[3, 0] > 0.02
    letters, bounds = toxicity.letters_of(pa.array(units))
    assert np.abs(model.margins(letters, bounds) - (want @ model.plane + 0.1)).max() < 1e-5


def test_units():
    def slow(text):
        words = text.lower().split()
        found = set(words) | {"".join(filter(str.isalnum, w)) for w in words}
        for w in words:
            most = max(map(w.count, w))
            found |= {w.replace(c, "") for c in [c for c in sorted(set(w)) if w.count(c) == most][-1:] if most >= 3 and 5 * most >= 2 * len(w)}
        found |= {x.replace(" ", "") for x in re.findall(r"(?<!\S)\S(?: \S){2,}(?!\S)", " ".join(words))}
        return found - {""}

    given = ["You i d i o t a bb c d", "", None, " lead. (x)  y!", "i", "a b", "z q r", "É. ß ǅ x", "a b c", "long " + "y" * 100, "ixxdxxixxoxxt y.y.y."]
    letters, bounds, text, unit = toxicity.units_of(pa.array(given))
    got = [set() for _ in given]
    for t, u in zip(text.tolist(), unit.tolist()):
        got[t].add("".join(map(chr, letters[bounds[u] : bounds[u + 1]])))
    assert got == [slow(t or "") for t in given]
    model = toxicity.Model(["^yyy"], np.ones(1), 0.0, 1.0, 0.0)
    assert [len(x) for x in toxicity.windows(*toxicity.letters_of(pa.array(["y" * 100, "ab", ""])))][:1] and model.kernel(["y" * 100])[0, 0] > 0.3


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 16)).astype(np.float32)
    x[100:130] = x[100]  # copies
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (None, x[0].tolist(), 0), (40, x[40].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    got = collections.defaultdict(list)
    for q, k, v, s in neighbours.nearest(df).collect():
        got[q].append((k, v, s))
    assert set(got) == set(range(0, 1500, 20))
    hits, y = 0, x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        s = y @ y[q]
        s[q] = -np.inf
        best = np.argsort(-s, kind="stable")[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[v] - w) < 1e-9 for _, v, w in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 121))
    assert neighbours.nearest(df.where("vec_id >= 2000")).count() == 0
    assert neighbours.nearest(df.where("vec_id < 5 OR vec_id = 20")).count() == 2 * 5


def recall(df, x, every=20, rounds=neighbours.ROUNDS):
    hits = total = 0
    y = x.astype(np.float64)
    for q, found in neighbours.nearest(df, every=every, rounds=rounds).groupBy("query_id").agg(F.collect_list("vec_id")).collect():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-s, kind="stable")[:20].tolist()))
        total += 20
    return hits / total


def test_neighbours_in_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 110)
    r = np.random.default_rng(3)
    centre = r.standard_normal(16)
    x = r.standard_normal((3000, 16)) - centre
    x[::3] = centre + 0.001 * r.standard_normal((1000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(df, x, 30) >= 0.9  # queries 0, 30, ...: all of the cluster


def naive_pieces(codec, text, document):
    """The segmentation by the letter: an agenda looked through anew for every candidate."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    score = {model.id_to_piece(i): (model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    out = []
    units = re.findall(" +[^ \n▁]*|[^ \n▁]+|\n|▁", " " + text) if text else []
    for place, unit in enumerate(units):
        key = pieces.unit_keys(np.array([document], np.uint64), np.array([place]))
        symbols, skipped, t = ["\0▁"] if unit == "▁" else list(unit.replace(" ", "▁")), set(), 0
        live = [[c, i] for i, c in enumerate(symbols)]
        while True:
            best = min(((-score[x[0] + y[0]][0], k) for k, (x, y) in enumerate(zip(live, live[1:])) if x[0] + y[0] in score and (x[1], x[0], y[0]) not in skipped), default=None)
            if best is None:
                break
            k = best[1]
            draw = int(pieces.draws(pieces.chained(key, t // 64), codec.rate)[0]) >> (t % 64) & 1
            t += 1
            if draw:
                skipped.add((live[k][1], live[k][0], live[k + 1][0]))
            else:
                live[k][0] += live.pop(k + 1)[0]
        for s, _ in live:
            out += [score[s][1]] if s in score else [int(codec.byte[b]) for b in s.replace("\0", "").encode()]
    return out


def ids_of(codec, given, document):
    return [np.frombuffer(x, "<u2").tolist() for x in codec.encode(pa.array(given), np.full(len(given), document, np.uint64)).to_pylist()]


def test_descent_is_what_finds_neighbours(spark, monkeypatch):
    """From two trees of small cells the graph of 20,000 vectors has few of the nearest neighbours; the rounds
    of neighbours of neighbours find nearly all."""
    for name, value in (("TREES", 2), ("CELL", 64), ("PER_TREE", 8)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(5)
    centres = r.standard_normal((200, 24))
    x = (centres[r.integers(0, 200, 20_000)] + 0.7 * r.standard_normal((20_000, 24))).astype(np.float32)
    nodes = common.saved(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<float>").repartition(4), "nodes")
    some = list(range(0, 20_000, 100))
    true = {q: set(np.argsort(-np.where(np.arange(20_000) == q, -np.inf, x.astype(np.float64) @ x[q].astype(np.float64)), kind="stable")[:20].tolist()) for q in some}

    def found(rounds):
        rows = neighbours.neighbour_graph(nodes, rounds).where(F.col("src").isin(some)).groupBy("src").agg(F.collect_list("dst")).collect()
        return sum(len(set(d) & true[s]) for s, d in rows) / (20 * len(some))

    first, last = found(0), found(neighbours.ROUNDS)
    assert first < 0.7 and last >= 0.9, (first, last)


def test_scores_of_double_vectors_are_exact(spark):
    x = np.random.default_rng(2).standard_normal((60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for q, _, v, s in neighbours.nearest(df).collect():
        assert abs(s - x[q] @ x[v]) < 1e-14


def test_pieces(docs, rows):
    import sentencepiece

    path = pieces.model_path()
    plain, model = pieces.Codec(path, 0.0), sentencepiece.SentencePieceProcessor(model_file=path)
    given = [t or "" for _, t in rows] + [" lead", "a  b\n\n c ", "tab\tx", "y" * 200, "z" * 30000, "\n", " ", "中文字 слово"]
    assert ids_of(plain, given, 0) == model.encode(given)
    hard = [*given, "▁ mark ▁▁", "a▁b", "▁", "▁  x\n▁"]
    codec = pieces.Codec(path)
    one, again, other = (ids_of(c, hard, v) for c, v in ((codec, 7), (pieces.Codec(path), 7), (codec, 8)))
    assert codec.decode(codec.encode(pa.array(hard), np.zeros(len(hard), np.uint64))).to_pylist() == hard and one == again and one != other
    assert [ids_of(codec, [x], 7)[0] for x in hard] == one  # a block's other texts don't matter
    short = [x for x in hard if len(x) < 2500]
    assert ids_of(codec, short, 7) == [naive_pieces(codec, x, 7) for x in short]
    got = pieces.round_trip(docs, path).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got) and min(r["n_tokens"] for r in got) == 0
    assert pieces.round_trip(docs.where("false"), path).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs.where("doc_id < 60"), path), path).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i is not None and i < 60 and i not in (9, 27))


def test_dropout_varies_by_occurrence():
    codec = pieces.Codec(pieces.model_path(), 0.2)
    n = 4000
    got = ids_of(codec, ["segmentation " * n], 3)[0]
    seen, word = collections.Counter(), []
    for i in got:
        piece = codec.raw[codec.raw_at[i] : codec.raw_at[i] + codec.raw_size[i]].tobytes().decode()
        if piece.startswith(" ") and word:
            seen[tuple(word)] += 1
            word = []
        word.append(i)
    assert len(seen) > 20 and 0.2 < max(seen.values()) / n < 0.9
    drawn = pieces.draws(np.arange(20000, dtype=np.uint64), 26)
    assert abs(np.mean([bin(int(x)).count("1") for x in drawn]) / 64 - 26 / 256) < 0.002


def test_warc(spark):
    r = random.Random(2)
    html = ["<p>" + prose(r, 80) + "</p>" for _ in range(30)]
    data = [(i, f"http://x/{i}", html[i % 25] if i % 9 else None, "clash") for i in range(60)] + [(7, "http://x/7", html[7], "clash"), (100, None, "", "clash"), (None, "http://n", html[3], "clash")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, path string").repartition(4)
    for least in (0, 10):
        got = warc.read_archives(warc.write_archives(pages, common.new_folder(spark, "warc"), least)).collect()
        last = {}
        for i, _, h, _ in data:
            if i is not None:
                last[utf(h)] = max(i, last.get(utf(h), -1))
        want = []
        for i, _, h, _ in data:
            revisit = len(utf(h)) >= least and last[utf(h)] != i
            want.append((str(i), len(utf(h)), warc.digest_of(utf(h)), "revisit" if revisit else "response", str(last[utf(h)] if revisit else None)))
        assert sorted((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], str(x["refers_to"])) for x in got) == sorted(want)
        assert all((x["payload"] is None) == (x["record_type"] == "revisit") for x in got)
    assert warc.read_archives(warc.write_archives(pages.where("false"), common.new_folder(spark, "warc"))).count() == 0


def test_warc_refuses_what_is_wrong():
    import io

    good = warc.record_of(1, "http://x", b"hello", None, False)
    assert warc.parse_record(good)["payload"] == b"hello"
    for bad in (good.replace(b"hello", b"hallo"), good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(bad)
    head, squeeze = warc.start_archive(b"some shared text " * 20)
    whole = head + squeeze.compress(good) + squeeze.compress(good)
    assert list(warc.read_archive(io.BytesIO(whole))) == [good, good]
    last = len(squeeze.compress(good))
    for cut in (*(whole[:-k] for k in range(1, last)), whole[8:], whole[:-last] + b"\x28\xb5"):
        with pytest.raises(warc.BadRecord):
            list(warc.read_archive(io.BytesIO(cut)))
    assert list(warc.read_archive(io.BytesIO(whole[:-last]))) == [good] and list(warc.read_archive(io.BytesIO(head))) == []


def water_fill(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(names)}
    target, free, budget = {}, set(names), sum(size.values())
    while free:
        left, w = budget - sum(target.values()), sum(weight[n] for n in free)
        over = [n for n in free if weight[n] * left / w > 3 * size[n]]
        target |= {n: 3.0 * size[n] for n in over} if over else {n: weight[n] * left / w for n in free}
        free = free - set(over) if over else set()
    return target


def brute_mix(rows):
    """[(doc_id, text)] in the order of the mix, by the letter; rows: (doc_id, text, source)."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += count(t)
    target = water_fill(size)
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    events = []
    for rank, name in enumerate(names):
        mine = sorted((hashlib.md5("|".join([mixing.SEED, *([] if i is None else [str(i)]), hashlib.md5(utf(t)).hexdigest()]).encode()).hexdigest(), count(t), i, t) for i, t, s in rows if s == name)
        total = 0
        for key, n, i, t in mine:
            total += n
            events += [((total + e * size[name]) / target[name], rank, e, key, n, i, t) for e in range(3) if target[name] > 0]
    out, words, budget = [], 0, sum(size.values())
    for *_, n, i, t in sorted(events, key=lambda x: x[:5]):
        words += n
        if words > budget:
            break
        if n:
            out.append((i, t))
    return out


def test_mixture(spark, docs):
    r = random.Random(9)
    share = {"a": 600, "b": 30, "c": 200, None: 150, "é": 20}
    data = [(i, prose(r, r.randrange(1, 60)), s) for i, s in enumerate(s for s, n in share.items() for _ in range(n))]
    df = spark.createDataFrame([(i, t, s, 5) for i, t, s in data], "doc_id long, text string, source string, size long").repartition(5)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = collections.Counter()
    for _, t, s in data:
        size[s] += count(t)
    got, again = ({x["doc_id"]: x for x in mixing.shares(d).collect()} for d in (df, df.repartition(2)))
    assert {k: v["taken"] for k, v in got.items()} == {k: v["taken"] for k, v in again.items()}
    want, taken = water_fill(size), collections.Counter()
    for i, t, s in data:
        x = got[i]
        assert x["size"] == count(t) and x["source_size"] == size[s] and abs(x["target"] - want[s]) < 1e-6 and x["taken"] in (0, x["size"], 2 * x["size"], 3 * x["size"])
        taken[s] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 130 for s in want) and sum(taken.values()) <= sum(size.values())
    order = [(x["doc_id"], x["text"]) for x in mixing.mixed(df.repartition(4)).collect()]
    assert order == brute_mix(data)
    copies = collections.Counter(i for i, _ in order)
    assert all(copies[i] == x["times"] for i, x in got.items())
    odd = [(1, "a b c", "s"), (1, "d e", "s"), (None, "f", "s"), (2, " ", "s"), (3, None, None), (4, "g h", None)]
    mixed = [(x["doc_id"], x["text"]) for x in mixing.mixed(spark.createDataFrame(odd, "doc_id long, text string, source string")).collect()]
    assert mixed == brute_mix(odd) and not {2, 3} & {i for i, _ in mixed}
    assert mixing.shares(docs).count() == docs.count() and mixing.mixed(docs).columns == docs.columns
    assert mixing.shares(df.where("false")).count() == 0 and mixing.shares(df.withColumn("text", df.source)).count() == len(data)
    assert mixing.shares(df.selectExpr("doc_id", "' ' AS text", "source")).agg({"taken": "sum"}).first()[0] == 0


def brute_components(rows):
    def shingles(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in utf(t)).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))
    find = lambda i: i if head[i] == i else find(head[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                head[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        name.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in name.items()}
    return sorted((str(d), len(sets[i]), str(least[find(i)])) for i, (d, _) in enumerate(rows))


def test_jaccard_join(spark, docs, rows, monkeypatch):
    want = brute_components(rows)
    for block in (256, 2):  # small blocks: all links are found across blocks
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert sorted(tuple(map(lambda x: x if isinstance(x, int) else str(x), (str(a), n, str(c)))) for a, n, c in jaccard_join.near_duplicates(docs).collect()) == want
    assert jaccard_join.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_jaccard_long_texts_and_a_full_sketch(spark, monkeypatch):
    """With counters too few to tell rare from frequent: links near 80 % are found, and long texts with some dozen
    shingles in common aren't taken up; shingles of one block alone don't get into the matrix; the sketch is small."""
    r = random.Random(8)
    monkeypatch.setattr(jaccard_join, "FEWEST", 128)
    monkeypatch.setattr(jaccard_join, "MOST", 128)
    made, save = {}, jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df, name: made.setdefault(name, save(df, name)))
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    passage = fresh(94)
    by_chance = [f"{fresh(1400)} {passage} {fresh(1400)}" for _ in range(2)]
    near = []
    for n in (100, 160, 300, 700, 1500):
        base = fresh(n).split()
        for edits in (n // 48, n // 45, n // 43, n // 40):
            words = list(base)
            for k in range(edits):
                words[10 + 7 * k] = f"x{r.randrange(10**9)}"
            near.append(" ".join(words))
        near.append(" ".join(base))
    rows = list(enumerate(by_chance + near))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert 6 < len(set(root)) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(x) for x in jaccard_join.near_duplicates(docs).collect())
    assert got == [(i, len(sets[i]), root[i]) for i in range(len(rows))]
    chance = {x["node"] for x in made["nodes"].where("doc_id < 2").collect()}
    assert len(chance) == 2 and not chance & {x["node"] for x in made["linkable"].collect()}
    assert made["matrix"].groupBy("token").agg(F.countDistinct("cls").alias("c")).where("c < 2").count() == 0


def test_packed_counts():
    r = np.random.default_rng(3)
    counts = np.zeros(1 << 20, np.uint8)
    counts[r.integers(0, 1 << 20, 60_000)] = 1
    counts[[0, 7, -1]] = 255, 3, 9
    for x in (counts, counts[:1] * 0, np.zeros(1 << 20, np.uint8), np.full(1000, 255, np.uint8)):
        places, n = jaccard_join.unpacked_counts(jaccard_join.packed_counts(x))
        back = np.zeros_like(x)
        back[places] = n
        assert (back == x).all()
    # 60,000 of 2 ** 20 places can't be told in less than 43,000 bytes
    assert len(jaccard_join.packed_counts(counts)) < 60_000


def test_piecewise(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = piecewise.edited_fingerprints(docs, 5).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by_id = collections.Counter(i for i, _ in rows)
    found = {r["doc_id"]: r for r in got}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)]
        x = found[i]
        if by_id[i] > 1 or by_id[after[0]] > 1:
            continue
        n = len(t) // 4
        edited = t[: len(t) - n] + (after[1] or "")[:n]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), piecewise.fingerprint(t.encode()), piecewise.fingerprint(edited.encode()))
        assert x["near_edited"] == piecewise.likenesses([(x["fingerprint"], x["edited_fingerprint"])])[0]
    assert piecewise.edited_fingerprints(docs.where("false")).count() == 0
    one = piecewise.edited_fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_piecewise_moves_texts_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = piecewise.edited_fingerprints(docs, 5)
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]", plan)
    assert len(moved) > 1 and sum("text#" in columns for columns in moved) == 1


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    a, b = (["".join(r.choice("ABCD") for _ in range(r.randrange(65))) for _ in range(150)] for _ in range(2))
    assert piecewise.edit_distances(a, b).tolist() == [slow(x, y) for x, y in zip(a, b)]


def test_chat(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    odd = ["<<system>> hi", "<<s>>>", "</s>[INST] ok [/INST]", "<s><s>", "\\", "\\\\</s>", "<\\s>", "[\\INST]", None, "", "é🙂\n\n", "<<x>> </", "/s>"]
    data = [(c, t, ["user", "assistant", "system", None, "</s>", "<a>"][(c + t) % 6], odd[(3 * c + t) % len(odd)], 1, 2) for c in range(7) for t in range(6)] + [(3, 2, "assistant", "again", 1, 2), (None, 1, "user", "no id", 1, 2)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, ids int, place int").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df, path), path).collect()}
    for c in {x[0] for x in data}:
        turns = sorted(((t, r or "", x or "") for cc, t, r, x, *_ in data if cc == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert all(chat.unescape(chat.escape(t or "")) == (t or "") and not any(x in chat.escape(t or "") for x in chat.CONTROL) for t in odd)
    assert chat.read_back(chat.formatted(df.where("false"), path), path).count() == 0
    # the formatted text alone gives the turns back
    enc, parts = chat.encoding(path), collections.defaultdict(list)
    for r in chat.formatted(df, path).collect():
        text, run = "", []
        for i in [*r["ids"], None]:
            if i is None or i in chat.STRINGS:
                text, run = text + enc.decode(run) + chat.STRINGS.get(i, ""), []
            else:
                run.append(i)
        parts[r["conv_id"]].append((r["place"], text))
    turn = re.compile(r"<s>\[INST\] (?:<<(?P<role>.*?)>> )?(?P<text>.*?) \[/INST\]|(?P<said>.*?) </s>", re.S)
    for c in {x[0] for x in data}:
        found = [("assistant", m["said"]) if m["said"] is not None else ("user" if m["role"] is None else m["role"], m["text"]) for m in turn.finditer("".join(t for _, t in sorted(parts[c])))]
        assert [tuple(map(chat.unescape, x)) for x in found] == [(r or "", x or "") for _, r, x in sorted((t, r or "", x or "") for cc, t, r, x, *_ in data if cc == c)]


def test_token_files(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    more = [(1000, "It's <|endoftext|> we'll İ é 　wide\xa0space 123 ...!?"), (1001, "ΑΣ ΣΑΣ Straße İx")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    folder = common.new_folder(spark, "tokens")
    got = token_files.crc_of_ids(token_files.read_token_files(token_files.write_token_files(docs.select("doc_id", "text").union(extra), folder, path, 2, docs_per_shard=7))).collect()
    t = Tokenizer.from_file(path)
    ids = {}
    for i, x in [*rows, *more]:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 2])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, v in ids.items() for x in v)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    none = token_files.write_token_files(docs.where("false"), common.new_folder(spark, "tokens"), path, 2)
    assert token_files.read_token_files(none).count() == 0
