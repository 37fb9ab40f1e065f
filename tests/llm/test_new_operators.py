"""Spelling variants, URL filters and the prefix trie against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables, hot groups and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sitewatch.llm import prefix_trie, spelling, url_filter

WORD = r"[^\x20\x09-\x0D]+"


# --- spelling ------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x), default=None) for w, v in near.items()}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelled(r, words):
    out = []
    for w in words:
        k, edit = r.randrange(len(w)), r.randrange(4)
        out.append([w, w[:k] + w[k + 1 :], w[:k] + r.choice("aeéz") + w[k:], w[:k] + r.choice("aeéz") + w[k + 1 :]][edit] if r.random() < 0.5 else w)
    return out


@pytest.mark.parametrize("cell,few", [(4096, 4), (20, 1), (3, 2)])
def test_spelling_variants(spark, monkeypatch, cell, few):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "QUERIES", 2)
    r = random.Random(cell)
    base = ["".join(r.choice("abcdefghilmnoprstuéàß") for _ in range(r.randrange(5, 10))) for _ in range(60)]
    alike = ["".join(r.sample("aqbrcs", 6)) for _ in range(60)]  # the same counts of letter groups, by the dozen
    alike += [w.translate(str.maketrans("aqbrcs", "qarbsc")) for w in alike[:20]] + [w + "a" for w in alike[:10]]
    long = ["x" * 90 + "end", "x" * 91 + "end", "x" * 89 + "yend", "lo" * 300, "lo" * 299 + "l", "z" * 40, "z" * 41]
    rows = [(None, None), (1, ""), (2, "   "), (3, "ÀÉ×÷ÿ Straße STRASSE straße ab abc"), (4, "a" * 5), (None, "Wording wording WORDING wordin wordin wordin")]
    for i in range(40):
        rows.append((i, " ".join(spelled(r, base + r.sample(alike, 30)) + long).replace(" ", "-" if i % 2 else "\n")))
    rows += [rows[-1], rows[-1], (7, " ".join(alike * 3))]
    rows += [(900 + i, "chainer " * 6 + "chainerz " * 2 + "chainerzz" * (i % 2)) for i in range(8)]  # a form of a form
    df = spark.createDataFrame([(i, t, "n", 5, 1) for i, t in rows], "doc_id long, text string, word string, n int, code int").repartition(3)
    want = brute_variants(brute_words(rows))
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == want
    assert any(w[1] and w[2] != w[1] for w in want) and sum(w[4] for w in want) > 100
    assert spelling.variants(df.where("false")).count() == 0 and spelling.variants(df.where("text = 'aaaaa'")).count() == 0


def test_near_is_one_edit():
    r = random.Random(1)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(1, 7))) for _ in range(80)] + ["a" * 70, "a" * 71, "a" * 30 + "b" + "a" * 39]
    import pyarrow as pa

    letters, offsets = spelling.latin(pa.array(words))
    assert [spelling.text(letters[offsets[i] : offsets[i + 1]]) for i in range(len(words))] == words
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert spelling.near(letters, offsets, a, b).tolist() == [one_edit(words[i], words[j]) for i, j in zip(a, b)]
    assert all(spelling.one_edit(x, y) == one_edit(x, y) for x in words for y in words)


# --- URL filters ---------------------------------------------------------------------------------


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def brute_urls(pages, rules):
    out, hosts, links = [], collections.defaultdict(list), collections.Counter()
    for page, url, html in pages:
        host, path = parsed(url)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit) if fit else (0, None, None)
        out.append((page, host, path, rule[1], rule[2]))
        if host:
            hosts[host].append(rule[2])
        to = {parsed("x:" + t if t.startswith("//") else t)[0] for t in re.findall(url_filter.LINK, html or "")}
        links.update((host, t) for t in to if host and t and t != host)
    for h in hosts:
        up = h.split(".", 1)[-1]
        if up != h and up in hosts:
            links.update([(h, up), (up, h)])
    mass = {}
    for kind, sign in (("trust", 1), ("distrust", -1)):
        seed = {h: max(0, sign * (v.count("allow") - v.count("block")) / len(v)) for h, v in hosts.items()}
        ways = [(a, b, n) if sign > 0 else (b, a, n) for (a, b), n in links.items()]
        total = collections.Counter()
        for a, _, n in ways:
            total[a] += n
        sent, all_ = dict(seed), collections.Counter(seed)
        for _ in range(200):
            go = collections.Counter()
            for a, b, n in ways:
                go[b] += url_filter.DAMPING * sent.get(a, 0) * n / total[a]
            sent = go
            all_.update(go)
        mass[kind] = all_
    bad = {h for h in hosts if mass["distrust"][h] >= url_filter.THRESHOLD and mass["distrust"][h] > mass["trust"][h]}
    return sorted([(p, h, path, rule, v or ("block" if h in bad else "allow")) for p, h, path, rule, v in out], key=str), mass


def test_url_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "DAMPING", 0.5)  # fewer rounds
    r = random.Random(6)
    names = ["good.com", "www.good.com", "a.net", "b.net", "c.org", "sub.c.org", "d.org", "e.org", "f.org", "x.example.com", "www.example.com", "example.com", "net", "com", "notcom", "g.io", "h.io"]
    pages = []
    for i in range(120):
        h = r.choice(names)
        near = [x for x in names if abs(names.index(x) - names.index(h)) < 4]
        html = "<p>" + " ".join(r.choice(["<a href='http://{}/x'>", '<A class="k" HREF = "//{}?q">', "<a href=https://{}>", "<a href='/local/{}'>", "<link href='http://{}'>"]).format(r.choice(near).upper() if i % 9 == 0 else r.choice(near)) for _ in range(r.randrange(4)))
        pages.append((i, f"http{'s' * (i % 2)}://{h.title() if i % 5 == 0 else h}{r.choice(['', '/', '/en/', '/en/x', '/es/1', '/fr/', '?q=/es/', '#/fr/', '/EN/', '/en'])}", None if i % 11 == 0 else html))
    pages += [(600 + i, f"http://bad.net/{'es/' if i else ''}{i}", "<a href='http://shill.io/'>" if i % 2 else "") for i in range(12)] + [(650 + i, f"http://shill.io/{i}", "<a href='http://bad.net'>") for i in range(3)]
    pages += [(500, None, "<a href='http://a.net'>"), (501, "", None), (502, "no scheme.com/en/", ""), (503, "://", ""), (504, "ftp://é.COM/ü?x", "x" * 200_000 + "<a href='http://c.org'>"), (None, "http://a.net/es/", None), pages[3], pages[3], (505, "a://b://c.com/en/", None)]
    df = spark.createDataFrame([(i, u, h, "v", "r", 1) for i, u, h in pages], "page_id long, url string, html string, verdict string, rule string, mass int").repartition(3)
    rules = url_filter.rule_table(spark)
    want, mass = brute_urls(pages, url_filter.RULES)
    got = url_filter.filtered(df, rules)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    judged = url_filter.with_rules(url_filter.addresses(df), rules)
    scores = url_filter.host_scores(judged, df).collect()
    assert len(scores) > 10
    for row in scores:
        assert abs(row["trust"] - mass["trust"][row["host"]]) < 2e-3 and abs(row["distrust"] - mass["distrust"][row["host"]]) < 2e-3
    assert url_filter.filtered(df.where("false"), rules).count() == 0
    none = url_filter.filtered(df, rules.where("false"))
    assert none.count() == len(pages) and none.where("verdict = 'allow' AND rule IS NULL").count() == len(pages)


def test_the_longest_rule_counts_and_of_equals_the_block(spark):
    rules = spark.createDataFrame([("allow", "a.com", "/"), ("block", "com", "/deep/path/"), ("block", "a.com", "/"), ("allow", "a.com", "")], "verdict string, r_host string, r_path string")
    df = spark.createDataFrame([(1, "x://a.com/"), (2, "x://b.a.com/deep/path/q"), (3, "x://a.com"), (4, "x://ba.com/deep/path/")], "page_id long, url string")
    got = url_filter.with_rules(url_filter.addresses(df), rules)
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == [(1, "a.com/", "block"), (2, "com/deep/path/", "block"), (3, "a.com", "allow"), (4, "com/deep/path/", "block")]


# --- prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows, family=True):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    built = {}
    for c, ts in convs.items():
        ts.sort()
        h = zlib.crc32(str(c).encode()) % 4 if family else 0
        base = sorted(convs.get(c - int(np.fmod(c, 20)), []))
        built[c] = [x[2:] for x in base[:h]] + [x[2:] for x in ts[h:]]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        n, words = len(members[p]), len(re.findall(WORD, p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out[p] = (min(members[p]), n, len(kids[p]), sum(out[k][3] for k in kids[p]) or 1, (n - 1) * words + sum(out[k][4] for k in kids[p]), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(((o[0], len(p), out[p[:-1]][0] if p else None, *o[1:]) for p, o in out.items()), key=str)


@pytest.mark.parametrize("family", [True, False])
def test_prefix_trie(spark, monkeypatch, family):
    """Small chapters, spans and chunks, so that every level has several."""
    for name, value in (("CHAPTER", 2), ("SPAN", 3), ("CHUNK_BITS", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    r = random.Random(9)
    rows = []
    texts = [None, "", "hi", "hi there", "ok\u00a0then \t x", "é 日本 🙂", "long " * 400]
    for c in [*range(-3, 70), 4000, 4001, 10**12]:
        for t in range(r.choice([1, 1, 2, 3, 4, 5, 9, 12, 30])):
            rows.append((c, r.choice([t, t, t, None]) if c % 5 == 0 else t, ["user", "assistant", None][t % 2 if t else r.choice([0, 2])], r.choice(texts[2 : 3 + t % 3 + (c % 3 == 0)])))
    for c in range(100, 160):  # copies of one conversation, some a turn longer or shorter
        rows += [(c, t, "user", f"turn {t}") for t in range(21 + (c % 20 == 0) - (c % 20 == 1))]
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's"), (300, None, None, None), (301, 7, "user", "x"), (301, 7, "user", "w"), (301, 7, "assistant", "z")]
    rows += [(500, t, "user", "on and on") for t in range(300)]
    df = spark.createDataFrame([(*x, 1, "d", 2) for x in rows], "conv_id long, turn long, role string, text string, n long, depth string, a int").repartition(5)
    got = prefix_trie.trie(df, family)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows, family)
    assert prefix_trie.trie(df.where("false"), family).count() == 0 and prefix_trie.trie(df.where("conv_id IS NULL"), family).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    got = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == brute_trie([(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
