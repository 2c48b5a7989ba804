"""Line templates and benchmark leaks against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from rostrum.llm import decontaminate, line_dedup, minhash_dedup

SCHEMA = "doc_id long, text string, leaf string, own int, key string, found int"


def mask(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))


def brute_lines(rows, min_docs=5):
    leaves, docs = defaultdict(set), defaultdict(list)
    for k, (d, t, *_) in enumerate(rows):
        for x in {mask(line) for line in (t or "").split("\n")}:
            w = x.split()
            if len(w) >= 3:
                leaves[len(w), *w[:3]].add(x)
    template = {}
    for leaf, lines in leaves.items():
        places = list(zip(*(x.split() for x in lines), strict=True))
        general = len(lines) > 1 and sum(len(set(p)) > 1 for p in places) <= math.floor(len(places) * 0.2)
        template |= {x: leaf if general else x for x in lines}
    for k, (d, t, *_) in enumerate(rows):
        for x in {template[m] for m in map(mask, (t or "").split("\n")) if m in template}:
            docs[x].append((math.inf if d is None else d, k))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        def lost(line):
            seen = docs.get(template.get(mask(line)), ())
            return len(seen) >= min_docs and (d is None or d > min(seen)[0])
        kept = [x for x in lines if not lost(x)]
        out.append((d, 0 if t is None else len(lines), len(lines) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()))
    return out


def line_corpus():
    rnd = random.Random(8)
    vocab = [f"{a}{b}" for a in "klmnop" for b in "aeiou"]
    rows = []
    for i in range(60):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.5:
            lines.insert(rnd.randint(0, len(lines)), f"Posted at {rnd.randint(1, 99)}:{rnd.randint(10, 59)}   by user{i}")
        if rnd.random() < 0.4:
            lines.append(f"Read more stories about {rnd.choice(vocab)} here")
        if rnd.random() < 0.3:
            lines.append("All rights reserved")
        if rnd.random() < 0.1:
            lines += ["All rights reserved", "", "  "]
        rows.append((i * 11 % 67, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "All rights reserved"), (None, "All rights reserved\nown line here"), rows[5], rows[5]]
    return [(d, t, "x", 1, "k", 2) for d, t in rows]


key = lambda r: tuple((x is None, x) for x in r)


def test_lines(spark):
    rows = line_corpus()
    want = brute_lines(rows)
    assert sum(r[2] for r in want) > 60
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, line_dedup.line_report(docs).collect()), key=key) == sorted(want, key=key)
    left = line_dedup.dedup_lines(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 102 not in ids and 100 in ids and 101 in ids and None in ids


def test_leaf_shuffle(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", -1)
    rows = line_corpus()
    got = line_dedup.line_report(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, line_dedup.line_report(docs, 3).collect())) == sorted(brute_lines(rows, 3))


@pytest.mark.parametrize("part", [1_000_000, 8])
def test_outlier_in_a_leaf(spark, monkeypatch, part):
    """Lines that share token count and lead with a template don't switch it off."""
    monkeypatch.setattr(line_dedup, "PART", part)
    rows = [(i, f"Read more stories about {a}{b} here\n{a}{b}") for i, (a, b) in enumerate((a, b) for a in "klmnop" for b in "aeiou")]
    rows += [(50, "Read more stories from our archive"), (51, "Read more stories from our archive\nRead more stories by Ann today")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(0 < i < 30) for i, _ in rows}


def test_short_lines_and_numbers(spark, tmp_path):
    """Lines of one or two words go like any other; rows of numbers only where all their tokens recur."""
    rows = [(i, f"Read more\n{i} {i + 7} {i * 3}\n1 2 3\nPage {i}\n0 0 0 0 {i}\nown{'x' * i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i == 0 else 2 for i, _ in rows}
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, min_tokens=1).collect()}
    assert left[7] == f"7 14 21\nPage 7\n0 0 0 0 7\nown{'x' * 7}"


def test_no_lines(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.line_report(empty).collect() == [] and line_dedup.dedup_lines(empty).collect() == []


def brute_leaks(docs, items):
    index = [(i, decontaminate.tokens_of(t)) for i, t in items if t and i is not None]
    index = [(i, t) for i, t in index if len(t) > 1]  # one token has no answer to verify
    n, mean = len(index), sum(len(t) for _, t in index) / max(1, len(index))
    df = Counter(w for _, t in index for w in set(t))
    # an item's passages start every 64, 128, 256, ... tokens, as its own length asks for
    stride = {i: next(s for s in (64 * 2**k for k in range(40)) if s >= len(t)) for i, t in index}
    out = []
    for d, text, *_ in docs:
        tokens, found = decontaminate.tokens_of(text), set()
        for i, own in index:
            for at in range(0, len(tokens), stride[i]):
                passage = tokens[at : at + 2 * stride[i]]
                score = lambda words, own=own: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, c in Counter(own).items() if w in words)
                if score(set(passage)) < 0.5 * score(set(own)) - 1e-9:
                    continue
                cut = max(1, len(own) * 2 // 3)
                size = min(5, cut)
                q = {tuple(own[k : k + size]) for k in range(cut - size + 1)}
                held = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
                a = Counter(own[cut:])
                if len(q & held) >= 0.75 * len(q) and (a & Counter(passage)).total() >= 0.75 * a.total():
                    found.add(i)
        out.append((d, len(found), bool(found), ",".join(map(str, sorted(found)))))
    return out


def leak_corpus():
    rnd = random.Random(2)
    vocab = [a + b + c for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    common_words = ["the", "of", "and", "to"]
    word = lambda: rnd.choice(common_words) if rnd.random() < 0.5 else rnd.choice(vocab)
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 12, 40, 90])))) for i in range(150)] + [(200, None), (201, " ! "), (None, "the of")]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rnd.randint(0, 400))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(words))
            own = (rnd.choice(items[:150])[1]).split()
            for _ in range(rnd.choice([0, 0, 1, 4])):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            words[at:at] = own
        docs.append((d, ", ".join(words).upper() if d % 9 == 0 else " ".join(words)))
    docs += [(300, None), (301, ""), docs[3], docs[3], (None, docs[4][1])]
    return [(d, t, "x", 1, "k", 2) for d, t in docs], items


@pytest.mark.parametrize("group_bytes", [4 << 20, 9000])
def test_leaks(spark, monkeypatch, group_bytes):
    docs, items = leak_corpus()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    df = spark.createDataFrame(docs, SCHEMA).repartition(2)
    # groups don't change the result
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", group_bytes)
    want = brute_leaks(docs, items)
    assert sum(r[2] for r in want) > 20
    assert sorted(map(tuple, decontaminate.leak_report(df, bench).collect()), key=key) == sorted(want, key=key)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((r[0] for r in want if not r[2]), key=str)


def test_other_items_lengths_do_not_matter(spark):
    """A question with its answer's words scattered far from it is no hit, however long another item is."""
    rnd = random.Random(5)
    vocab = [a + b + c + d for a in "bcdf" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    filler = lambda n: [rnd.choice(vocab) + "x" for _ in range(n)]
    items = [(i, " ".join(rnd.sample(vocab, 30))) for i in range(20)]
    docs = []
    for i, t in items:
        own = t.split()
        scattered = own[:20] + [w for a in own[20:] for w in (*filler(40), a)]
        docs += [(2 * i, " ".join(filler(50) + own + filler(50))), (2 * i + 1, " ".join(filler(50) + scattered))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    few = {tuple(r) for r in decontaminate.leak_report(df, bench(items)).collect()}
    assert few == {(2 * i, 1, True, str(i)) for i in range(20)} | {(2 * i + 1, 0, False, "") for i in range(20)}
    long = [(100, " ".join(f"other{k}" for k in range(6000))), (101, " ".join(f"some{k}" for k in range(200)))]
    assert {tuple(r) for r in decontaminate.leak_report(df, bench(items + long)).collect()} == few
    both = spark.createDataFrame([(1, " ".join(filler(5000)) + f" {long[0][1]} " + docs[0][1])], "doc_id long, text string")
    assert decontaminate.leak_report(both, bench(items + long)).first()["items"] == "0,100"


@pytest.mark.parametrize("slab", [64, 256])
def test_leaks_in_slabs(spark, monkeypatch, slab):
    """Long texts in overlapping slabs give what whole texts give."""
    docs, items = leak_corpus()
    items = [(i, t) for i, t in items if t and i is not None]
    docs = [(d, t) for d, t, *_ in docs if t and d is not None]
    batch = pa.RecordBatch.from_pydict({"key": [d for d, _ in docs], "text": [t for _, t in docs]})
    indexes = decontaminate.by_length(items)
    assert [i.stride for i in indexes] == [64, 128]
    hits = lambda: {(k, i) for out in decontaminate._hits(indexes)(iter([batch])) for k, i in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    whole = hits()
    monkeypatch.setattr(decontaminate, "SLAB", slab)
    assert hits() == whole and len(whole) > 20


def test_leaks_of_a_very_long_text():
    """50 MB in one text, with an item near its end."""
    indexes = decontaminate.by_length([(7, "which of the old ports lies nearest to the cape of storms answer simons town")])
    text = "word " * 10_000_000 + indexes[0].tokens[0][0] + " " + " ".join(indexes[0].tokens[0][1:]) + " and on"
    tracemalloc.start()
    (out,) = decontaminate._hits(indexes)(iter([pa.RecordBatch.from_pydict({"key": [3], "text": [text]})]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pydict() == {"key": [3], "item_id": [7]} and peak < 300 << 20


def test_leaks_empty(spark):
    docs, items = leak_corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs[:5], SCHEMA)
    assert [r["n_items"] for r in decontaminate.leak_report(df, none).collect()] == [0] * 5
    assert decontaminate.leak_report(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_leaks_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    assert sorted(map(tuple, decontaminate.leak_report(docs, bench).collect())) == sorted(brute_leaks(rows, items))


def test_clashing_columns(spark):
    """Names that operators use inside may be the user's own."""
    names = ["doc_id", "text", "key", "row", "__row_key", "lost", "edited", "dropped"]
    rows = [(i, f"the same old line here\nown {'abcdefgh'[i]} words of this text", *"pqrstu") for i in range(8)]
    docs = spark.createDataFrame(rows, names)
    left = line_dedup.dedup_lines(docs)
    assert left.columns == names and sorted(tuple(r)[2:] for r in left.collect()) == [tuple("pqrstu")] * 8
    bench = spark.createDataFrame([(1, "own a words of this text")], "item_id long, text string")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == names and {tuple(r)[2:] for r in clean.collect()} == {tuple("pqrstu")}
    near = minhash_dedup.representatives(docs)
    assert near.columns == names and {tuple(r)[2:] for r in near.collect()} == {tuple("pqrstu")}


def test_very_long_text(spark):
    """A text of 50 MB in one line, and one of as much in many lines."""
    long = "word " * 10_000_000
    lines = "\n".join(f"line of the text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)} goes on" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, lines * 4), *((i, "short shared line\nown") for i in range(3, 9))], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_report(docs).collect()}
    assert got[1] == (1, 0) and got[2][0] == 4 * 399_999 + 1 and got[3] == (2, 0) and got[8] == (2, 1)
    sizes = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert sizes[1] == (1, 1) and sizes[2][1] == 2 and sizes[8][1] == 3
