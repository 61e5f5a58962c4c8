"""The operators on training data: brute force, round trips, odd rows and held-out accuracy."""

import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.llm import boilerplate, mapping, mixing, packing, pieces, queries, scans, sentences, tokens, toxicity, truncation

WORDS = "the patient cohort before mortality covered answer within separated second injury modern clinical department".split()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1 — noise of scanned pages


def counts():
    return {w: 400 for w in WORDS} | {"0.0": 300, "00": 200, "clay": 3, "day": 500, "re": 30, "estimated": 40}


def test_misread_words_and_numbers():
    r = scans.Reader(counts())
    assert [r.misread(t) for t in ("rnortality", "bef0re", "seconcl", "witliin", "4.S", "l2", "irijury,")] == [True] * 7
    assert [r.misread(t) for t in ("mortality", "modern", "S24.12", "Unknownword", "ZZ-84", "12.5%", "x" * 5000, "日本語" * 500)] == [False] * 8


def test_hyphens_and_repair():
    r = scans.Reader(counts())
    assert r.damage("the mor-\ntality") == (True, False) and r.damage("re-\nestimated day") == (False, False) and r.damage("co\xadhort") == (False, False)
    assert r.damage("co\xad\nhort bcfore") == (True, True)
    assert r.repair("The co¬\nhort bcfore mor-\ntality") == "The cohort before mortality"
    assert r.repair("the thepatient") == "the the patient"


def test_damage_comes_from_the_path():
    r = scans.Reader(counts())
    # Split or merged as well as misread: no token of these is confused with a word on its own.
    assert not any(map(r.misread, "mor tal1ty bcforethe ta1 ity".split()))
    assert r.damage("the mor tal1ty of") == (False, True) and r.damage("a bcforethe patient") == (False, True)
    assert r.damage("the mor-\nta1 ity") == (True, True) and r.damage("the thepatient, mor tality") == (False, False)


def test_repair_writes_the_path():
    r = scans.Reader(counts() | {"mortalité": 90, "élevée": 90, "letalität": 90, "war": 200, "patienten": 90, "mit": 200, "a" * 60: 50, "was": 300, "in": 300, "high": 90, "well": 50, "known": 50})
    for damaged, whole in (
        ("the mor tality was high", "the mortality was high"), ("In Themortality was", "In The mortality was"), ("mortalitéélevée was", "mortalité élevée was"), ("der Letalitätwar in", "der Letalität war in"),
        ("Pa tienten mit", "Patienten mit"), ("the mor-\ntal1ty, bcforethe day", "the mortality, before the day"), ("the mor\ntality was", "the mortality\nwas"), ("a well-\nknown patient", "a well-known patient"),
        ("the mor tality was the mor tality", "the mortality was the mortality"), ("in " + "a" * 25 + "-\n" + "a" * 35 + " was", "in " + "a" * 60 + " was"), ("(sec0nd), ca\xad\nnot", "(second), canot"), ("", ""), ("  ", "  "),
    ):
        assert r.repair(damaged) == whole, damaged
    long = ("the mor tality of " * 3000).strip()
    assert r.repair(long) == ("the mortality of " * 3000).strip()


def test_planted_damage_is_repaired():
    rnd = random.Random(11)
    words = [w for w in WORDS if len(w) > 5] * 3 + ["the", "before"]
    r = scans.Reader(counts())

    def damage(w):
        kind, at = rnd.randrange(5), rnd.randrange(2, len(w) - 1) if len(w) > 3 else 0
        if not at or kind == 0:
            return w + " "
        if kind == 1:
            return w[:at] + "-\n" + w[at:] + " "
        if kind == 2:
            return w[:at] + " " + w[at:] + " "
        if kind == 3:
            return w  # merged with the next
        return w.replace("m", "rn", 1).replace("l", "1", 1).replace("o", "0", 1) + " "

    good = total = 0
    for _ in range(300):
        clean = [rnd.choice(words) for _ in range(8)]
        got = r.repair("".join(damage(w) if rnd.random() < 0.3 else w + " " for w in clean)).split()
        good += len(set(clean) & set(got)) / len(set(clean)) * 8
        total += 8
    assert good / total > 0.97, good / total


def test_counts_of_a_large_corpus_shrink(spark):
    df = frame(spark, [("the patient " * 10 + "slip",)] * 6, "t string")
    assert scans.count_parts(df) == {"the": 60, "patient": 60, "slip": 6}
    assert scans.count_parts(df, reference=21) == {"the": 10, "patient": 10}
    assert scans.count_parts(df.limit(0)) == {}


def test_titles_beyond_the_broadcast(spark, monkeypatch):
    df = frame(spark, [("f", f"r{i}") for i in range(40)] + [(None, "n"), ("g", "g")], "file string, record_id string")
    titles = frame(spark, [("f", "F")], "file string, title string")
    want = sorted((r.record_id, r.title) for r in scans.with_titles(df, titles).collect())
    monkeypatch.setattr(scans, "MOST_TITLES", 0)
    assert sorted((r.record_id, r.title) for r in scans.with_titles(df, titles).collect()) == want and len(want) == 42


def test_headers_and_numbers():
    title = "Early lactate in Northtown admissions"
    assert all(scans.is_header(x, title) for x in (title, title.upper(), "Early lactate ...   12", "EARLY LACTATE IN", "Earlv lactate in".replace("v", "y"), "12   Ear1y 1actate in Northtown"))
    assert not any(scans.is_header(x, title) for x in ("Early in the day", "Lactate", "", "The annals of this ward are long and were read by all.")) and scans.is_header("Annals of Inland Medicine 2018", None)
    assert [bool(scans.number_line(x)) for x in ("– 3 –", "p. 19", "Page 3 of 9", "[12]", "l2", "xiv", "12", "Methods", "a 3", "12.5 mg")] == [True] * 7 + [False] * 3


def test_page_numbers_stand_alone():
    assert scans.page_number_lines("a title\nsome text\n12") == [2] and scans.page_number_lines("– 3 –\nx\ny\nz") == [0]
    assert scans.page_number_lines("Values\n310\n156") == [] and scans.page_number_lines("see p.\n1841.") == [] and scans.page_number_lines(" ") == []


def test_noise_rows(spark):
    rows = [("page_document", "f:p1", "f", 1, "Early lactate in Northtown\nthe bcfore\n– 1 –"), ("page_document", "f:p1", "f", 1, "Early lactate in Northtown\nthe bcfore\n– 1 –"), ("passage", "x", None, None, None), ("passage", "y", "f", 2, " ")]
    df = frame(spark, rows, "table_name string, record_id string, file string, page int, text string")
    titles = frame(spark, [("f", "Early lactate in Northtown admissions")], "file string, title string")
    got = sorted(r.noise_kind for r in scans.find_noise(spark, df, counts(), titles).collect())
    assert got == ["misread", "page_number", "running_header"]
    fixed = [(r.record_id, r.text) for r in scans.repair_texts(spark, df, counts(), titles).collect()]
    assert sorted(fixed, key=str) == [("f:p1", "the before")] * 2 + [("x", None), ("y", " ")]
    assert scans.find_noise(spark, df.limit(0), {}, titles).count() == 0


def test_pages_lose_the_printed_lines_of_their_passages(spark):
    first, second = "the patient.\n310\n156\nthe cohort.\n- 3 -", "- 3 -\nthe injury.\nthe day.\n12"
    rows = [("page_document", "f:p1", "f", 1, "the\nday.\n" + first + "\n\nthe second.\n" + second + "\nthe\nanswer.\nday."), ("passage", "f:p1:c0", "f", 1, first), ("passage", "f:p1:c1", "f", 1, second)]
    df = frame(spark, rows, "table_name string, record_id string, file string, page int, text string")
    fixed = {r.record_id: r.text for r in scans.repair_texts(spark, df, counts(), frame(spark, [], "file string, title string")).collect()}
    assert not re.search(r"- 3 -|\b12\b", fixed["f:p1"]) and "310" in fixed["f:p1"] and "156" in fixed["f:p1"] and "injury" in fixed["f:p1"]


def test_paragraphs():
    lines = [("The cohort was followed for a long time and nobody", False), ("left it before the end of the year.", True), ("Another paragraph begins here, and it goes on for", False), ("two lines.", False)]
    assert len(scans.paragraphs(lines)) == 2 and scans.paragraphs([]) == []
    assert len(scans.paragraphs([(f"line {i} of a long paragraph that goes on and", False) for i in range(500)])) == 1
    rnd = random.Random(12)
    for _ in range(200):
        some = [("x" * rnd.randrange(1, 50) + rnd.choice(["", ".", ",", " and"]), rnd.random() < 0.2) for _ in range(rnd.randrange(1, 9))]
        assert "\n".join(scans.paragraphs(some)) == "\n".join(x for x, _ in some)


# 2 — oversized texts


def test_pieces_round_trip():
    rnd = random.Random(1)
    for _ in range(40):
        text = "".join(rnd.choice(["a", "b", " ", ". ", "\n", "\n\n", ", ", "。", "日", "é"]) for _ in range(rnd.randrange(0, 3000)))
        limit, overlap = rnd.choice([(100, 0), (100, 20), (257, 99)])
        cut = pieces.cut(text, limit, overlap)
        assert all(e - s <= limit for s, e, _ in cut) and cut[0][0] == 0 and cut[-1][1] == len(text)
        assert all(a[1] - b[0] == overlap for a, b in zip(cut, cut[1:]))
        force = pieces.strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32)) if len(text) > limit else []
        for s, e, f in cut[:-1]:
            window = force[s + max(overlap + 1, limit // 2) - 1 : s + limit]
            assert f == window.max() and not (window[e - s - max(overlap + 1, limit // 2) + 1 :] == f).any()


def test_pieces_rows(spark):
    df = frame(spark, [("a", "x" * 50), ("b", None), ("c", ""), ("d", "short")], "id string, text string")
    got = pieces.split_oversized(df, "id", limit=20, overlap=5).orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece_no) for r in got] == [("a", 1), ("a", 2), ("a", 3), ("c", 1), ("d", 1)]
    with pytest.raises(ValueError):
        pieces.cut("x" * 50, 20, 20)


def test_pieces_of_both_tables(spark, tmp_path):
    long = "word " * 600
    frame(spark, [("f:p1", long), ("f:p1", long), ("f:p2", None)], "page_id string, text string").write.parquet(f"{tmp_path}/page_document.parquet")
    frame(spark, [("f:p1:c0", "short"), ("f:p1:c1", long)], "passage_id string, text string").write.parquet(f"{tmp_path}/passage.parquet")
    got = sorted((r.table_name, r.record_id, r.piece_no) for r in queries.p2_pieces(spark, str(tmp_path)).collect())
    assert got == [("page_document", "f:p1", 1), ("page_document", "f:p1", 2), ("passage", "f:p1:c0", 1), ("passage", "f:p1:c1", 1), ("passage", "f:p1:c1", 2)]


# 3 — canonical list


def test_mapping():
    ix = mapping.TermIndex([(1, "Blood lactate"), (1, "lactic acid"), (2, "Interleukin 6"), (2, "IL-6"), (3, "Interleukin 8"), (4, "APACHE II"), (5, "Troponin T"), (6, "28-day mortality"), (7, "Age"), (8, "PT"), (9, "C-reactive protein")])
    same = {"blood  LACTATE": 1, "bloood lactae": 1, "Lactate blood": 1, "lactate of blood": 1, "peak blood lactate (per SD)": 1, "blооd lactate": 1, "IL6": 2, "Ｉnterleukin_8": 3, "Apahce II": 4, "28‐day mortality*": 6, "Creactive protein": 9}
    other = {"Interleukin 17": 0, "IL-18": 0, "Troponin I": 0, "30-day mortality": 0, "APACHE IV": 0, "Moon phase": 0, "PCT": 0, "": 0, "Interleukin": 0}
    for value, term in (same | other).items():
        assert ix.find(value, False) == term, value
    assert ix.find("28-day mort", True) == 6 and mapping.TermIndex([]).find("x", True) == 0


def test_mapping_rows(spark):
    rows = frame(spark, [(1, "Age; moon phase", "28-day mortality", 0), (1, "Age; moon phase", "28-day mortality", 1), (2, "N/A", " ", 2), (3, None, "x" * 81, 3)], "row_id long, predictor string, outcome string, term_id int")
    terms = frame(spark, [(7, "predictor", "Age", "years|"), (6, "outcome", "28-day mortality", None)], "term_id int, field_name string, term_name string, aliases string")
    got = sorted((r.row_id, r.field_name, r.item_no, r.term_id) for r in mapping.map_fields(rows, terms).collect())
    assert got == [(1, "outcome", 1, 6), (1, "predictor", 1, 7), (1, "predictor", 2, 0)]


# 4 — sentences


def model():
    return sentences.Model(
        {"en": {"dr": (0.0, 50), "no": (0.0, 20), "etc": (0.9, 10), "fig": (0.0, 30), "i.e": (0.0, 9), "a.m": (0.0, 5)}, "de": {"z": (0.0, 9), "b": (0.0, 9)}},
        {"en": {"the", "we", "samples"}, "de": {"der"}},
        {"en": {("no", "##"), ("fig", "##")}, "de": {("##", "märz")}},
        {"en": {"army"}},
        {"และก"},
    )


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Dr. Smith saw it. We agree, see Fig. 3 of it.", ["Dr. Smith saw it.", "We agree, see Fig. 3 of it."]),
        ("It was given, etc. The end was no. 5.", ["It was given, etc.", "The end was no. 5."]),
        ('He asked "Is it so? Call me." and left the room.', ['He asked "Is it so? Call me." and left the room.']),
        ("(These were not part of the set.) The rest was.", ["(These were not part of the set.)", "The rest was."]),
        ("It remains open ... The end of it ...or not.", ["It remains open ...", "The end of it ...or not."]),
        ("护士说：“已经升高。请通知。”随后记录。随访结束……（其中未纳入。）完", ["护士说：“已经升高。请通知。”随后记录。", "随访结束……", "（其中未纳入。）", "完"]),
        ("ค่าแลคเตท1.5 อัตราตาย24.8%  การวัดซ้ำ", ["ค่าแลคเตท1.5", "อัตราตาย24.8%", "การวัดซ้ำ"]),
        ("The value fell in the end.The rest of it rose.", ["The value fell in the end.", "The rest of it rose."]),
        ("Am 12. März wurden die Werte z. B. nicht und der Rest bei 3. Der Wert stieg.", ["Am 12. März wurden die Werte z. B. nicht und der Rest bei 3.", "Der Wert stieg."]),
        ("Τι είναι αυτό που βλέπουμε εδώ σήμερα; Η τιμή ανέβηκε.", ["Τι είναι αυτό που βλέπουμε εδώ σήμερα;", "Η τιμή ανέβηκε."]),
        ("no mark at all", ["no mark at all"]),
        ("It was the U.K. Army of J. Q. Smith, see Dr. Army of it.", ["It was the U.K. Army of J. Q. Smith, see Dr. Army of it."]),
        ("The end was etc. Army of it.", ["The end was etc.", "Army of it."]),
        ("ค่าแลคเตท1.5 และการวัดซ้ำ อัตราตาย24.8%", ["ค่าแลคเตท1.5 และการวัดซ้ำ", "อัตราตาย24.8%"]),
        (f"The {'x' * 200}. {'Y' * 200} was it. Dr.{' ' * 200}Smith saw {'z' * 90}-no. 3 of it.", [f"The {'x' * 200}.", f"{'Y' * 200} was it.", f"Dr.{' ' * 200}Smith saw {'z' * 90}-no. 3 of it."]),
        ("", []), (None, []), ("  \n ", []),
    ],
)
def test_sentences(text, parts):
    ends, start, got = sentences.Splitter(model()).ends(text), 0, []
    for e in ends:
        got.append(text[start:e].strip())
        start = e
    assert got == parts


def test_learning_abbreviations(spark):
    rnd = random.Random(2)
    texts = []
    for _ in range(400):
        name, other = rnd.choice(["Adams", "Brown", "Clark"]), rnd.choice(WORDS)
        texts.append((f"The {other} was seen by Dr. {name} in the ward. We saw that the {other} was not in fig. {rnd.randrange(90)} of the {rnd.choice(WORDS)}. The ward and it were the {rnd.choice(WORDS)} of the {rnd.choice(WORDS)}. No {other} was lost, see No. {rnd.randrange(99)} of it.",))
    m = sentences.learn(frame(spark, texts + [(None,), ("",)], "t string"))
    assert {"dr", "fig", "no"} <= set(m.abbreviations["en"]) and "ward" not in m.abbreviations["en"] and "the" in m.starters["en"]
    assert not sentences.learn(frame(spark, [], "t string")).abbreviations
    # The same rates in ten times as many texts give the same model, stray spellings without a period included.
    texts += [("Seen by Dr Adams in fig 3 of the ward.",)] * 2
    once, ten = (sentences.learn(frame(spark, texts * n, "t string"), reference=8_000) for n in (1, 10))
    assert {"dr", "fig", "no"} <= set(once.abbreviations["en"]) and once.starters and once.collocations
    assert (once.starters, once.collocations, once.common, once.within) == (ten.starters, ten.collocations, ten.common, ten.within)
    assert {k: v[0] for k, v in once.abbreviations["en"].items()} == {k: v[0] for k, v in ten.abbreviations["en"].items()}


def test_learning_thai_blanks(spark):
    rnd = random.Random(9)
    starts, goes_on = ["ค่าแลคเตท", "อัตราตาย", "พื้นที่ใต้โค้ง", "ผู้ป่วยทั้งหมด"], ["และลดลง", "ในวันที่"]
    texts = [(" ".join(x for _ in range(4) for x in (rnd.choice(starts) + str(rnd.randrange(9)), *rnd.sample(goes_on, rnd.randrange(2)))),) for _ in range(300)]
    m = sentences.learn(frame(spark, texts, "t string"))
    assert m.within == {x[: sentences.OPENING] for x in goes_on}


def test_language_of_the_whole_text():
    assert sentences.languages("The end of it was 患者 not that.", "The end of it was 患者 not that.".split())[0] == "en"
    late = "x " * 5000 + "α" * 30000
    assert sentences.languages(late, late.split())[0] == "el"
    assert sentences.languages("α2 of the end", "α2 of the end".split()) == ("en", False)


# 6 — cut-off values


def test_truncation(spark):
    rnd = random.Random(3)
    body = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(6, 14)))
    rows = []
    for i in range(600):
        # A JSON value also counts if the text quoted in it was cut; here only whole texts are quoted.
        a = f"{body().capitalize()} in the ward. {body().capitalize()} at the end."
        whole = json.dumps({"x": a})
        rows.append((i, "s", a if i % 10 else a[: len(a) - rnd.randrange(12, 30)].rstrip(), "28-day mortality" if i % 10 != 1 else "28-day mortality"[: rnd.randrange(8, 15)], whole if i % 10 != 2 else whole[:-20]))
    rows += [(700, "s", None, "", "N/A"), (701, None, "x…", "28-day mortality", '{"x": "y",}'), (0, "s", *rows[0][2:])]
    df = frame(spark, rows, "row_id long, source_file string, source_anchor string, outcome string, field_sources_json string")
    got = truncation.find_truncated(spark, df)
    cut = {(r.row_id, r.field_name) for r in got.where("cut").collect()}
    true = {(i, "source_anchor") for i in range(0, 600, 10)} | {(i, "outcome") for i in range(1, 600, 10)} | {(i, "field_sources_json") for i in range(2, 600, 10)} | {(701, "source_anchor")}
    assert len(cut & true) > 0.95 * len(true) and len(cut - true) < 0.05 * len(true)
    assert truncation.truncation_rates(got).where("source_file = 's' and field_name = 'outcome'").first().n_values == 600


def test_threshold_lies_in_the_valley():
    size = int((truncation.HIGH - truncation.LOW) / truncation.STEP)
    bins = truncation.LOW + truncation.STEP * (np.arange(size) + 0.5)
    heap = lambda at, n: n * np.exp(-((bins - at) ** 2))
    for share in (0.01, 0.1, 0.4):
        assert -6 < truncation.threshold(heap(-8, share * 1000) + heap(1, (1 - share) * 1000), heap(-8, 500)) < -1
    assert truncation.threshold(np.zeros(size), heap(-8, 9)) == truncation.LOW == truncation.threshold(heap(1, 9), np.zeros(size))


def test_tails_and_texts_count_alike():
    """A tail's counters are those of the same characters within a text; digits are one sign."""
    a = truncation.tail_buckets(["at day 12", "AT DAY 79", "12", ""], 1)
    assert (a[:, 0] == a[:, 1]).all() and (a[:2, 2] == a[:2, 0]).all() and (a[2:, 2] == -1).all() and (a[:, 3] == -1).all()
    assert (truncation.tail_buckets(["at day 12"], 2)[:, 0] != a[:, 0]).all()


# 7 — repeated lines


def test_repeated_lines_match_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    usual = ["Share this page", "Reading time 12 min", "– 3 –", "ok", "All rights stay with us."]
    rows = []
    for i in range(300):
        lines = [" ".join(rnd.choice(WORDS) for _ in range(6)) for _ in range(rnd.randrange(4))]
        lines += [rnd.choice([u, u.upper(), u.replace(" ", "  "), re.sub(r"\d+", str(rnd.randrange(99)), u)]) for u in usual if rnd.random() < 0.3]
        rows.append((f"d{i}", rnd.choice(["a", "a", "b", None, "tiny"]) if i > 5 else "tiny", None if i % 50 == 0 else "\n".join(lines)))
    rows += rows[:40]
    seen, docs = {}, {}
    for i, s, t in set(rows):
        docs[s] = docs.get(s, 0) + 1
        for x in set(map(boilerplate.line_key, (t or "").split("\n"))):
            seen[s, x] = seen.get((s, x), 0) + 1
    hot = lambda s, x: any(map(str.isalpha, x)) and seen[s, boilerplate.line_key(x)] >= max(8, 0.1 * docs[s])
    want = {(i, n) for i, s, t in set(rows) for n, x in enumerate((t or "").split("\n"), 1) if hot(s, x)}
    df = frame(spark, rows, "passage_id string, source_file string, text string")
    lines = boilerplate.repeated_lines(df)
    assert {(r.passage_id, r.line_no) for r in lines.collect()} == want and want
    clean = {r.passage_id: r for r in boilerplate.without_lines(df.distinct(), lines.distinct()).collect()}
    assert len(clean) == 300 and sum(r.lines_removed for r in clean.values()) == len(want)
    assert boilerplate.repeated_lines(df.limit(0)).count() == 0
    monkeypatch.setattr(boilerplate, "MOST_CHUNKS", 0)  # the same by a join with salted sources
    assert {(r.passage_id, r.line_no) for r in boilerplate.repeated_lines(df).collect()} == want


def test_chunks_depend_on_the_line_alone():
    a = boilerplate.chunk_lines(pa.array(["Some line to share with all of you\nx", "y\nSome  LINE to share with all of you", None, ""]))
    first, second = a[2][(a[0] == 0) & (a[1] == 1)], a[2][(a[0] == 1) & (a[1] == 2)]
    assert len(first) > 0 and (first == second).all()


# 8 — containers


def test_packing(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([0, 3, 17, 40, 64, 100, 250, rnd.randrange(1, 300)])) for i in range(2000)] + [(9000, None)] + [(i, 30) for i in range(10000, 11000)]
    df = frame(spark, sizes, "doc_id long, n_tokens int")
    for capacities in ([64], [100], [32, 64, 100]):
        rows = packing.pack(spark, df, capacities).collect()
        fill, cap, total = {}, {}, {}
        for r in rows:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            cap[r.container] = r.capacity
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            assert r.n_tokens == max(capacities) or dict(sizes)[r.doc_id] > max(capacities) or r.piece_no == 1
        assert all(fill[c] <= cap[c] and cap[c] in capacities for c in fill) and total == {i: n for i, n in sizes if n}
        assert all(cap[c] == min(x for x in capacities if x >= fill[c]) for c in fill)
        if len(capacities) == 1:
            # As many containers as best fit decreasing, item by item, would open.
            room, opened = {}, 0
            for n in sorted((r.n_tokens for r in rows), reverse=True):
                at = min((x for x in room if x >= n), default=None)
                opened += at is None
                left = (at or capacities[0]) - n
                if at is not None:
                    room[at] -= 1
                    room = {k: v for k, v in room.items() if v}
                room[left] = room.get(left, 0) + 1
            assert len(fill) == opened
    assert packing.pack(spark, df.limit(0), [8]).count() == 0
    sized = df.where("n_tokens > 0").select("doc_id", F.lit(1).alias("piece_no"), "n_tokens")
    histogram = {r.n_tokens: r["count"] for r in sized.groupBy("n_tokens").count().collect()}
    got: dict[int, list[int]] = {}
    for r in packing.numbered(sized, "doc_id", histogram, rows=100).collect():
        got.setdefault(r.n_tokens, []).append(r.number)
    assert all(sorted(v) == list(range(histogram[s])) for s, v in got.items()) and len(got) == len(histogram)
    with pytest.raises(ValueError):
        packing.pack(spark, df, [])


def test_tokens_of_long_texts():
    try:
        assert tokens.count_tokens(None) == 0 and tokens.count_tokens("") == 0
        assert tokens.count_tokens("word " * 20_000) >= 20_000
        encode, rnd = tokens.encoding(tokens.VOCABULARY).encode_ordinary, random.Random(13)
        for parts in (["word", " ", "  ", "\n", "don't", "12", "é"], ["日本", "語", "。", "、", "1", "「", "」"], ["ผู้ป่วย", "ทั้งหมด"], ["a", "b"]):
            text = "".join(rnd.choice(parts) for _ in range(30_000))
            assert tokens.count_tokens(text) == len(encode(text))
    except FileNotFoundError:
        pytest.skip("no vocabulary file")


# 9 — mixtures


def test_flow_prefers_few_repetitions():
    total, routes = mixing.solve({("a",): 100, ("b",): 40, ("a", "b"): 60}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 200)
    assert total == 200 and sum(routes.values()) == 200 and routes[("b",), "b"] + routes.get((("a", "b"), "b"), 0) == 100
    assert mixing.solve({}, {"a": 1.0}, {"a": 2}) == (0, {}) and mixing.solve({("a",): 10}, {"a": 0.5, "none": 0.5}, {"a": 2, "none": 1})[0] == 20


def test_mixture(spark, monkeypatch):
    rnd = random.Random(6)
    docs = [(i, rnd.choice("aaab"), f"text {i} " + "x " * rnd.randrange(30)) for i in range(600)] + [(1000 + i, "c", f"text {i} ") for i in range(3)] + [(2000, "other", "z"), (2001, None, "z"), (2002, "a", None), (2003, "a", "")]
    df = frame(spark, docs, "doc_id long, source string, text string")
    sized = df.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    targets = frame(spark, [("a", 0.5, 1), ("b", 0.5, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(spark, df, sized, targets)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["a"].actual_share - 0.5) < 0.02 and abs(s["b"].actual_share - 0.5) < 0.02 and s["gone"].tokens == 0
    monkeypatch.setattr(mixing, "ROWS", 50)  # more groups, the same tape
    again = {r.source: r.tokens for r in mixing.mix(spark, df, sized, targets)[1].collect()}
    assert again == {k: r.tokens for k, r in s.items()}
    assert s["a"].most_uses <= 1 and s["b"].most_uses <= 4 and chosen.groupBy("source", "doc_id").count().where("count > 1").count() == 0


def test_other_columns_change_nothing(spark):
    """Columns with the names that the operators use within, and nulls in every column."""
    names = "key n lang title places file of _gone lines count odds inner cut score flagged piece piece_no n_items container capacity number members pattern digest _salt _h at word next total one lines_removed sentence_no".split()
    more = lambda df: df.select("*", *(F.lit("x").alias(c) for c in names if c not in df.columns))
    same = lambda a, b, keep: sorted(map(str, a.select(*keep).collect())) == sorted(map(str, b.select(*keep).collect()))
    texts = frame(spark, [("a", "s", "The end. It was so. " * 20 + "\nShare it"), ("b", None, None), (None, None, "x\nShare it"), ("c", "s", "")], "passage_id string, source_file string, text string")
    assert same(pieces.split_oversized(texts, "passage_id", limit=100, overlap=9), pieces.split_oversized(more(texts), "passage_id", limit=100, overlap=9), ["passage_id", "piece_no", "piece"])
    m = sentences.learn(texts.select("text"))
    assert same(sentences.split_sentences(texts, m), sentences.split_sentences(more(texts), m), ["passage_id", "end_char"])
    lines = boilerplate.repeated_lines(texts, least=1)
    assert same(lines, boilerplate.repeated_lines(more(texts), least=1), ["passage_id", "line_no"]) and lines.count() > 1
    assert same(boilerplate.without_lines(texts, lines), boilerplate.without_lines(more(texts), lines), ["passage_id", "text"])
    records = texts.select(F.lit("passage").alias("table_name"), F.col("passage_id").alias("record_id"), F.col("source_file").alias("file"), "text")
    titles = frame(spark, [("s", "Share it all")], "file string, title string")
    for run, keep in ((scans.find_noise, ["record_id", "noise_kind"]), (scans.repair_texts, ["record_id", "text"])):
        assert same(run(spark, records, counts(), titles), run(spark, more(records), counts(), more(titles)), keep)
    rows = frame(spark, [(1, "s", "A text.", "28-day mort", "{"), (2, None, None, None, None), (None, "s", "A text", "x", "{}")], "row_id long, source_file string, source_anchor string, outcome string, field_sources_json string")
    assert same(truncation.find_truncated(spark, rows), truncation.find_truncated(spark, more(rows)), ["row_id", "field_name", "odds", "cut"])
    docs = frame(spark, [(1, "a", "you idiot"), (2, None, None), (None, "a", "fine"), (3, "b", "x" * 200_000)], "doc_id long, source string, text string")
    rated = frame(spark, [(1, "r", 1), (3, "r", 0), (None, "r", 1), (2, None, None)], "doc_id long, rater string, toxic int")
    assert same(toxicity.score_documents(spark, docs, rated), toxicity.score_documents(spark, more(docs), more(rated)), ["doc_id", "score", "flagged"])
    sized = docs.select("doc_id", F.length("text").alias("n_tokens"))
    assert same(packing.pack(spark, sized, [50]), packing.pack(spark, more(sized), [50]), ["doc_id", "piece_no", "n_tokens"])
    targets = frame(spark, [("a", 0.5, 2), ("b", 0.5, None), (None, None, None)], "source string, target_share double, max_repeats int")
    assert same(mixing.mix(spark, docs, sized, targets)[1], mixing.mix(spark, more(docs), more(sized), more(targets))[1], ["source", "tokens"])
    values = frame(spark, [(1, "Age; x", "Age"), (2, None, None), (None, "Age", "")], "row_id long, predictor string, outcome string")
    terms = frame(spark, [(7, "predictor", "Age", None), (None, None, None, None)], "term_id int, field_name string, term_name string, aliases string")
    assert same(mapping.map_fields(values, terms), mapping.map_fields(more(values), more(terms)), ["row_id", "field_name", "item_no", "term_id"])


# 10 — offending content


def test_threshold_of_ratings():
    scores, truth = np.array([0.9, 0.8, 0.7, 0.2, 0.1] * 400), np.array([1, 1, 1, 0, 0] * 400, bool)
    assert 0.3 < toxicity.best_threshold(scores, truth, np.ones(2000), 0.03) < 0.6
    assert toxicity.best_threshold(scores, np.zeros(2000, bool), np.ones(2000), 0.03) == 0.5
    fitted = toxicity.Fitted([], scores, truth, ["en", "de"] * 1000)
    assert set(toxicity.thresholds(fitted, 0.03)) == {"", "en", "de"}


def test_sentences_as_the_net_sees_them():
    words = toxicity.sentences_of
    assert words("You are an i.d.i.o.t! Go.") == words("You are an idiot! Go.") and words("IDIOOOOT") == words("idiot") == words("idi0t")
    assert words("a\u200bb \uff41") == words("ab a") and words(None) == words("") == words("12 34") == []
    assert words("再測定すべき drop dead") == [*words("再測定すべき"), *words("drop dead")]
    long = words(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)))
    assert all(len(s) <= toxicity.SPAN for s in long) and {w for s in long for w in s} == {w for i in range(100) for s in words(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}") for w in s}


def test_classifier_held_out(spark):
    rnd = random.Random(7)
    bad = ["you are a stupid idiot", "go to hell you pig", "those people are vermin", "I will break your fingers, idiot"]

    def text(toxic):
        own = [" ".join(rnd.choice(WORDS) for _ in range(7)).capitalize() + "." for _ in range(rnd.randrange(2, 7))]
        return " ".join(own[:1] + [rnd.choice(bad).capitalize() + "."] * toxic + own[1:])

    labels = [int(rnd.random() < 0.3) for _ in range(400)]
    docs = frame(spark, [(i, "s", text(y)) for i, y in enumerate(labels)] + [(900, None, None), (901, "s", "")], "doc_id long, source string, text string")
    rated = [(i, "r", y if rnd.random() > 0.05 else 1 - y) for i, y in enumerate(labels[:250])] + [(0, "q", None)]
    got = toxicity.score_documents(spark, docs, frame(spark, rated, "doc_id long, rater string, toxic int"))
    flags = {r.doc_id: r.flagged for r in got.collect()}
    assert len(flags) == 402 and not flags[900] and not flags[901]
    assert sum(flags[i] == bool(y) for i, y in enumerate(labels) if i >= 250) > 0.93 * 150
    assert toxicity.toxic_rates(got).where("source = 's'").first().n_docs == 401
    none = toxicity.score_documents(spark, docs, frame(spark, [], "doc_id long, rater string, toxic int"))
    assert none.where("flagged").count() == 0


def test_all_documents_take_part(spark):
    # 6,600 ratings, the offending ones the last by hash: a sample of the first 6,000 has none of them.
    ids = [r.id for r in spark.range(6600).orderBy(F.xxhash64("id")).collect()]
    bad, rnd = set(ids[-400:]) | set(range(7000, 7010)), random.Random(3)
    docs = frame(spark, [(i, "s", "You are a stupid idiot." if i in bad else " ".join(rnd.choice(WORDS) for _ in range(5))) for i in [*ids, *range(7000, 7500)]], "doc_id long, source string, text string")
    rated = frame(spark, [(i, "r", int(i in bad)) for i in ids], "doc_id long, rater string, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(spark, docs, rated).collect()}
    assert len(got) == 7100 and {i for i, r in got.items() if r.flagged} == bad
    again = {r.doc_id: r.score for r in toxicity.score_documents(spark, docs.repartition(3), rated).collect()}
    assert all(abs(again[i] - r.score) < 0.001 for i, r in got.items())
    # Parts of the documents, trained in tasks of their own.
    nets = toxicity.fit(spark, toxicity.tokens_of(docs, rated), parts=3)
    codes = [toxicity.body_of(t) for t in ("You are a stupid idiot.", "the patient cohort before mortality")]
    assert (toxicity.logits_of(nets, codes)[:, 0] > 0).all() and (toxicity.logits_of(nets, codes)[:, 1] < 0).all()


def test_changes_of_parts():
    known = np.zeros(toxicity.BUCKETS, bool)
    known[[5, 6, 5000]] = True
    a, b, start = (toxicity.Learner.new(1, known) for _ in range(3))
    for learner, words in ((a, [5, 6]), (b, [5, 5000])):
        learner.learn([(["".join(map(chr, words))], 1.0, 1.0, True)], np.random.default_rng(0), False, True)
    made = {}
    for block, change in [*a.changes(start), *b.changes(start)]:
        made.setdefault(block, []).append(change)
    both = toxicity.Learner.new(1, known)
    for block, own in made.items():
        both.take(block, toxicity.mean_change(block, iter(own)))
    assert np.allclose(both.net.out, (a.net.out + b.net.out) / 2, atol=1e-6) and np.allclose(both.net.emb[5], (a.net.emb[5] + b.net.emb[5]) / 2, atol=1e-6)
    # A word that one part has is not held back by the other.
    assert np.allclose(both.net.emb[6], a.net.emb[6], atol=1e-6) and np.allclose(both.net.emb[5000], b.net.emb[5000], atol=1e-6) and not both.net.emb[7].any()


def test_thresholds_of_counts():
    rnd = np.random.default_rng(2)
    scores, truth, langs = rnd.random(300).round(1), rnd.random(300) < 0.4, rnd.choice(["en", "de"], 300).tolist()
    counts = Counter(zip(scores, truth, langs))
    s, t, names = zip(*counts)
    one, other = toxicity.thresholds(toxicity.Fitted([], scores, truth, langs), 0.1), toxicity.thresholds(toxicity.Fitted([], np.array(s), np.array(t), list(names), np.array(list(counts.values()), float)), 0.1)
    assert one.keys() == other.keys() and all(abs(one[x] - other[x]) < 1e-9 for x in one)
