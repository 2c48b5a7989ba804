"""Documented examples of the functions, on tiny tables, and properties of the operators."""

import hashlib
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

import __spark_entry__
from rostrum.functions import dates, names, text
from rostrum.operators import cluster, drift, enrich, extract, facets, order, topics
from rostrum.sources import files
from rostrum.sources.schema import SPEECH, conform
from rostrum.streaming import stream


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert apply(spark, names.normalize_mp_name, "John Doe'nın", "Mehmet Ali, additional text", "A’nın", None, "") == ["John Doe", "Mehmet Ali", "A", "", ""]
    assert apply(spark, lambda c: names.first_words(c, 3), "Ahmet Mehmet Yılmaz Öztürk") == ["Ahmet Mehmet Yılmaz"]
    assert apply(spark, names.clean_party_name, "Cumhuriyet Halk Partisi Extra Text", "Demokrat Parti Something", "Bağımsız") == ["Cumhuriyet Halk Partisi", "Demokrat Parti", "Bağımsız"]
    assert apply(spark, names.party_without_term, "17.dönem ANAP", "ANAP", "17.dönem ") == ["ANAP", "ANAP", "17.dönem "]
    assert apply(spark, names.is_valid_name, "Ali Veli", "Ali ve Veli", "x" * 46) == [True, False, False]
    assert apply(spark, names.folded, "Kamer Genç", "Alâettin Kurt") == ["kamer genc", "alaettin kurt"]
    assert apply(spark, names.strip_possessive, "Ayşe Kaya'nın", "Ali Demirin") == ["Ayşe Kaya", "Ali Demir"]


def test_dates(spark):
    assert apply(spark, dates.header_date, "20 .1 .1988", "3 1 . 1 0 . 2007", "6 . 11 . 2 0 0 8", "none", "7.5.1943 ve 8.5.1943") == ["20.01.1988", "31.10.2007", "06.11.2008", None, "07.05.1943"]
    assert apply(spark, dates.parsed, "01.00.1984", "75.10.1985") == [None, None]
    assert apply(spark, dates.term_of, "term27-year3-session21-48", "invalid-id") == [27, None]
    row = spark.range(1).select(dates.sort_key(F.lit(17), F.lit(1)), dates.session_id(F.lit("tbmm17001001"), F.lit(17), F.lit(1)), dates.session_id(F.lit("tbmm28002002.txt"), F.lit(28), F.lit(2)), dates.term_year_label(F.lit(17), F.lit(1), F.lit(1983), F.lit(1984))).first()
    assert tuple(row) == (1701, "term17-year1-session001", "term28-year2-session2", "d17y1 (1983-1984)")


def test_texts(spark):
    assert apply(spark, text.format_topic_name, "23_sel_zarar_yağış_felaketi", None, "") == ["Sel Zarar Yağış Felaketi", "Unknown Topic", "Unknown Topic"]
    assert apply(spark, text.extract_keywords, "x Anahtar kelimeler: sel, zarar,, afet</s>\ny", "one", "") == ["sel, zarar, afet", text.NO_KEYWORDS, text.NO_KEYWORDS]
    assert apply(spark, text.clean_topic_name, 'Başlık: "SEL zararı"') == ["Sel Zararı"]
    assert apply(spark, text.keywords_fallback, "a, b, c", "a, b, c, d, e") == ["A ve B ve C", "A B C"]
    assert apply(spark, text.remove_hyphens, "Mec- lis 3-4 a-b") == ["Meclis 3-4 ab"]
    assert apply(spark, text.clean_text, "Sayın Başkan, http://x.y  ﬁnans ve 12 SEL") == ["finans sel"]
    assert apply(spark, lambda c: text.filter_keywords(c, F.array(F.lit("Meclis"))), "meclisin, sel", "Meclis") == ["sel", "Meclis"]


def test_canonical_name(spark):
    rows = spark.createDataFrame([("John Doe", "Party A", [17, 18]), ("John Doe'", None, [])], "name string, party string, terms array<int>")
    groups = spark.createDataFrame([("John Doe", "g"), ("John Doe'", "g")], "name string, root string")
    got = enrich.canonical_names(rows, groups).first()
    assert (got["canonical"], got["party"], got["terms"], got["names"]) == ("John Doe", "Party A", [17, 18], 2)


def test_fuzzy_party(spark):
    members = spark.createDataFrame([(17, "Kamer Genç", "A"), (17, "Alâettin Kurt", "B"), (18, "Kamer Genc", "C")], "term int, mp_name string, party string")
    said = spark.createDataFrame([(17, "Kamer Genc"), (17, "Alaettin Kurt"), (17, "Nobody"), (18, "Kamer Genc")], "term int, speech_giver string")
    got = {(r["term"], r["speech_giver"]): r["party"] for r in enrich.fuzzy_party(said, members).collect()}
    assert got == {(17, "Kamer Genc"): "A", (17, "Alaettin Kurt"): "B", (17, "Nobody"): None, (18, "Kamer Genc"): "C"}


def test_bounds_never_undercut(spark):
    words = ["kamer", "karem", "aaa", "a", "", "mehmet ali", "ali mehmet"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = df.select(names.ratio("a", "b").alias("r"), names.length_bound(F.col("a"), F.col("b")).alias("l"), names.letters_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert all((x["r"] <= x["l"] + 1e-12 and x["r"] <= x["m"] + 1e-12) or x["r"] == 1.0 for x in got)


ERA_A = """TUTANAK 20 .1 .1988
A) GÜNDEM DIŞI KONUŞMALAR
1. — Ankara Milletvekili Ali Demir'in, sel hakkında gündem dışı konuşması
2. — İzmir Milletvekili Ayşe Kaya'nın, yol hakkında gündem dışı konuşması
4. — Bursa Milletvekili Can Ak'ın, atlanan numara hakkında gündem dışı konuşması
B) DİĞER
A) GÜNDEM DIŞI KONUŞMALAR
1. — Ankara Milletvekili Ali Demir'in, sel hakkında gündem dışı konuşması
ALİ DEMİR (Ankara) — Sayın millet-
vekilleri, sel oldu.
BAŞKAN — Teşekkür ederim.
2. — İzmir Milletvekili Ayşe Kaya'nın, yol hakkında gündem dışı konuşması
AYŞE KAYA (İzmir) — Yol bozuk."""
ERA_B = """V.- AÇIKLAMALAR
1.- Ankara Milletvekili Ali Demir'in, sel hakkında açıklaması 12:34
2.- İzmir Milletvekili Ayşe Kaya'nın, yol hakkında açıklaması 13
1.- Ankara Milletvekili Ali Demir'in, sel hakkında açıklaması
Sel oldu.
İkinci satır.
VI.- ÖNERGELER
başka"""


def test_transcripts(spark, tmp_path):
    for name, body in (("d17-y1/tbmm17001001.txt", ERA_A), ("d28-y2/tbmm28002002/result.mmd", ERA_B), ("d17-y1/fih.txt", "x"), ("d17-y1/a_gnd.txt", "x")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    found = files.transcripts(spark, str(tmp_path))
    assert sorted((r["name"], r["term"], r["year"]) for r in found.collect()) == [("tbmm17001001.txt", 17, 1), ("tbmm28002002", 28, 2)]
    assert [r["name"] for r in files.transcripts(spark, str(tmp_path), term=28).collect()] == ["tbmm28002002"]
    census = {r["dir"].rsplit("/", 1)[1]: (r["counted"], r["excluded"]) for r in files.census(spark, str(tmp_path)).collect()}
    assert census == {"d17-y1": (1, 2)}
    old = found.where("term = 17").select(F.col("name").alias("file"), "content")
    got = {r["speech_no"]: r for r in extract.speeches_with_index(old).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1]["province"], got[1]["speech_giver"], got[1]["content"]) == ("Ankara", "Ali Demir", "ALİ DEMİR (Ankara) — Sayın milletvekilleri, sel oldu.")
    assert got[2]["speech_giver"] == "Ayşe Kaya" and got[2]["content"].endswith("Yol bozuk.")
    new = found.where("term = 28").select(F.col("name").alias("file"), "content")
    got = {r["speech_no"]: r for r in extract.speeches_in_section(new).collect()}
    assert (got[1]["page_ref"], got[1]["content"]) == ("12:34", "Sel oldu. İkinci satır.") and got[2]["content"] == ""


def test_party_for_term(spark):
    page = "<p>17. DönemMilliyetçi Demokrasi PartisiİzmirMilletvekili</p><p>18. Dönem Anavatan Partisi Ankara Milletvekili</p>"
    df = spark.createDataFrame([(page,)], "p string")
    assert tuple(df.select(extract.party_for_term(F.col("p"), F.lit(17)), extract.party_for_term(F.col("p"), F.lit(18)), extract.party_for_term(F.col("p"), F.lit(19))).first()) == ("Milliyetçi Demokrasi Partisi", "Anavatan Partisi", None)


def test_word_pieces(spark):
    rows = [(1, 0, "Mec", "ORG", 0.8), (1, 1, "##lis", "ORG", 0.4), (1, 2, "Ali", "PER", 0.9), (1, 3, "##x", "LOC", 0.5)]
    got = drift.merge_word_pieces(spark.createDataFrame(rows, "d int, pos int, word string, entity_group string, score double"), ["d"]).orderBy("pos").collect()
    assert [(r["word"], r["entity_group"], round(r["score"], 6)) for r in got] == [("Meclis", "ORG", 0.6), ("Ali", "PER", 0.9), ("x", "LOC", 0.5)]


def test_density_clusters(spark, monkeypatch):
    points = [(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(4)] + [(20, [-1.0, -1.0])]
    df = spark.createDataFrame(points, "k long, v array<double>")
    for block in (2048, 3):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = {r["k"]: r["cluster"] for r in cluster.dbscan(df, "k", "v", 0.05, 3).collect()}
        assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 14), 10), 20: -1}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = dict(map(tuple, cluster.connected_components(edges).collect()))
    assert roots == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_alignment_is_stable(spark):
    rows = [(17, 1, 0, [1.0, 0.0], 5), (17, 1, 1, [0.0, 1.0], 4), (17, 2, 0, [0.0, 0.9], 9), (18, 1, 7, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "term int, year int, cluster long, centroid array<double>, size long")
    first = {(r["term"], r["year"], r["cluster"]): r["global_id"] for r in cluster.align(df).collect()}
    assert first == {(17, 1, 0): 0, (17, 1, 1): 1, (17, 2, 0): 1, (18, 1, 7): 2}
    assert first == {(r["term"], r["year"], r["cluster"]): r["global_id"] for r in cluster.align(df).collect()}
    assert {r["global_id"] for r in cluster.align(df, cap=2, first_cap=2).where("term = 18").collect()} == {-1}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, x string, y int")
    new = spark.createDataFrame([(2, 5), (3, 6)], "k int, y int")
    once = enrich.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, enrich.upsert(once, new, "k").collect())) == [(1, "a", 1), (2, "b", 5), (3, None, 6)]


def test_shared_new_id(spark):
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (4, [0.0, 1.0])], "topic_id int, centroid array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], "k int, embedding array<double>")
    got = {r["k"]: r["topic_id"] for r in topics.assign(rows, centers, "k").collect()}
    assert got == {1: 0, 2: 5, 3: 6}
    assert {r["topic_id"] for r in topics.assign(rows, centers, "k", shared_new_id=True).where("is_new").collect()} == {5}


def test_conform_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("x", "17", [1, 2])], "id string, term string, terms_served array<int>")
    assert conform(df).schema == SPEECH
    files.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).select(files.int_list(F.col("terms_served"))).first()
    assert back[0] == [1, 2]


def test_percents_stay_under_100(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 7), ("b", 1, 5)], "g string, t int, cnt long")
    assert all(r["pct"] <= 100 for r in facets.shares(df, ["g"]).collect())


def test_close_names_find_all(spark):
    words = ["blue bolt", "blue bolts", "blu bolt", "bluebolt", "red ring", "red rings!", "x", "y", "ab", "abcd"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    for most in (1, 2, 3):
        lev = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).where("a < b").where(F.levenshtein("a", "b") <= most)
        assert {tuple(r) for r in enrich.close_names(df, "n", most).collect()} == {tuple(r) for r in lev.collect()}


def test_similar_names_against_all_pairs(spark):
    rnd = random.Random(5)
    people = ["Mustafa Kemalettin Erdogan", "Mstafa Kemalettin Erdogn"]
    for _ in range(40):
        one = " ".join("".join(rnd.choices("abcdeiklmnrstuyzğışİ", k=rnd.randint(2, 9))) for _ in range(rnd.randint(1, 4)))
        people.append(one)
        for _ in range(2):
            other = list(one)
            for _ in range(rnd.randint(1, 3)):
                other[rnd.choice([0, 1, -1, -2, rnd.randrange(len(other))])] = rnd.choice("abcdeikl")
            people.append("".join(other))
    people = sorted(set(people))
    df = spark.createDataFrame([(p,) for p in people], "speech_giver string")
    short = {p: " ".join(p.split()[:3]).lower() for p in people}
    for threshold in (0.8, 0.9):
        want = {(a, b) for a in people for b in people if a != b and SequenceMatcher(None, short[b], short[a]).ratio() >= threshold}
        assert {(r["name_a"], r["name_b"]) for r in enrich.similar_names(df, threshold=threshold).collect()} == want
    assert tuple(people[people.index(x)] for x in ("Mustafa Kemalettin Erdogan", "Mstafa Kemalettin Erdogn")) in want


def test_whole_texts(spark, tmp_path):
    texts = ["a b  c d " + "x" * 600 + " ve Çağrı", "y" * 300 + " ile " + "z" * 300 + " Âî", "W" * 700, "ve", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = __spark_entry__.queries()
    found = {r["doc_id"]: (r["head"], r["conj"]) for r in queries["F22_first_words_whole"](spark, str(tmp_path)).collect()}
    assert found == {i: (" ".join(x.split()[:3]), bool({"ve", "ile"} & set(x.lower().split(" ")))) for i, x in enumerate(texts)}
    fold = str.maketrans("çğıöşüâîûÇĞİÖŞÜÂÎÛI", "cgiosuaiucgiosuaiui")
    got = {r["doc_id"]: r["folded"] for r in queries["F24_folded_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(x.translate(fold).lower().encode()).hexdigest() for i, x in enumerate(texts)}


def test_numbers_in_order(spark):
    rows = [(i, i % 3 or None, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    want = {}
    for g in (None, 1, 2):
        want |= {i: n for n, (_, i) in enumerate(sorted((v, i) for i, h, v in rows if h == g))}
    assert {r["id"]: r["n"] for r in order.numbered(df, ["v", "id"], ["g"]).collect()} == want
    assert sorted(r["n"] for r in order.numbered(df, ["v", "id"]).collect()) == list(range(200))


def test_ingest_over_several_runs(spark, tmp_path):
    """Files that come later are taken up by the next run; each key's latest row stays, and batches share no new topic."""
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for k in range(3):
        spark.createDataFrame([(i, k) for i in range(k, k + 3)], "id int, run int").coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema("id int, run int").parquet(source)
        stream.run_once(arriving, out, checkpoint, "append", stream.ingest_sink(spark, out, "id"))
    assert stream.versions(spark, out) == [0, 1, 2]
    assert sorted(map(tuple, stream.current(spark, out, arriving.schema).collect())) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]
    centers = spark.createDataFrame([(7, [1.0, 0.0])], "topic_id int, centroid array<double>")
    sink = stream.topic_sink(spark, f"{tmp_path}/topics", centers, "id", 0.9)
    for n, batch in enumerate(([(1, [1.0, 0.1]), (2, [0.0, 1.0])], [(3, [-1.0, 0.0])])):
        sink(spark.createDataFrame(batch, "id int, embedding array<double>"), n)
    got = {r["id"]: r["topic_id"] for r in stream.all_versions(spark, f"{tmp_path}/topics", "id int, topic_id int, sim double, is_new boolean").collect()}
    assert got == {1: 7, 2: 8, 3: 9}


def test_long_labels(spark):
    long = "uzun bir açıklama metni " * 4
    forms = [f"**başlık:** Eğitim Politikası **gerekçe:** {long}", f'{long} **başlık** Eğitim Politikası"', f"{long} **proposed Title** Eğitim Politikası", f"**Eğitim Politikası ve Okullar** {long}", f"**Kısa** {long}".strip(), "Kısa etiket"]
    assert apply(spark, text.cleaned_label, *forms) == ["Eğitim Politikası"] * 3 + ["Eğitim Politikası ve Okullar", forms[4], "Kısa etiket"]


def test_ranked_matches(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.95), ("a", "d", 0.97)], "name_a string, name_b string, similarity double")
    members = spark.createDataFrame([("b", None), ("c", "X"), ("d", "")], "n string, party string")
    got = enrich.ranked_matches(pairs, members, "n").orderBy("rank").collect()
    assert [r["name_b"] for r in got] == ["d", "c", "b"]


def test_refined_topics(spark):
    actions = spark.createDataFrame([(1, 3, "move"), (2, 3, "keep"), (3, 3, "recluster"), (4, 3, "recluster"), (5, 3, "recluster")], "id int, best_topic int, action string")
    clustered = spark.createDataFrame([(3, 3), (4, 3), (5, -1)], "id int, cluster int")
    got = {r["id"]: r["topic_id"] for r in topics.refined(actions, clustered, "id", 4, 20).collect()}
    assert got == {1: 3, 2: 4, 3: 21, 4: 21, 5: -1}


def test_best_tokens_when_few_counts_are_sent(spark, monkeypatch):
    """Only frequent tokens' counts are sent along; the rest is joined, and the n best are those of all."""
    import math
    import random
    from collections import Counter

    random.seed(5)
    docs = [(i, " ".join(f"w{min(int(random.expovariate(0.12)), 60)}" for _ in range(random.randint(0, 30))) or None) for i in range(60)]
    words = {i: Counter((t or "").split()) for i, t in docs}
    df = Counter(w for c in words.values() for w in c)
    want = {(i, w) for i, c in words.items() for w in sorted(c, key=lambda w: (-round(c[w] * math.log(len(docs) / df[w]), 9), w))[:4]}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for sent in (0, 1, 12, 1000):
        monkeypatch.setattr(text, "SENT", sent)
        got = text.best_tokens(frame, "doc_id", "text", 4)
        assert {(r["doc_id"], r["token"]) for r in got.collect()} == want
        if sent == 12:  # tokens that are sent along are in most of the rows; the others' rows alone are joined by a shuffle
            least = text.frequent_from(text.document_frequencies(frame, "text"), sent)
            assert 0 < sum(n >= least for n in df.values()) <= sent < len(df)
