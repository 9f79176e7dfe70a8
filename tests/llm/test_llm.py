"""The operators for training data on small tables: known cases, brute force, and what breaks naive forms."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirelake.llm import bpe, canon, channels, lattice, matching, matchrules, mixing, mojibake, names, residue, survivor, truncation

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


# p7: encoding
def brute_encode(text, vocabulary):
    rank = {(a, b): (k, m) for k, (a, b, m) in enumerate(vocabulary["merges"])}
    out = []
    for word in bpe.SPLIT.findall(text):
        ids = [vocabulary["bytes"][b] for b in word.encode()]
        while True:
            best = min(((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
        out += ids
    return out


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


def test_encoder_against_brute_force(vocabulary):
    texts = ["", "a", "aaaaaaaaaa", "Hello  world\n\n ok", "naïve café — 本研究 🙂", "<|endoftext|>", "x" * 3000, "don't 12345 it's\t"]
    flat, offsets = bpe.PairIndexEncoder(vocabulary).encode(texts)
    assert [flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == [brute_encode(t, vocabulary) for t in texts]


def test_encoder_forgets_words_without_harm(vocabulary):
    encoder = bpe.PairIndexEncoder(vocabulary, cached_words=3)
    for text in ("one two three", "four five six seven", "one seven"):
        flat, _ = encoder.encode([text])
        assert flat.tolist() == brute_encode(text, vocabulary)


def test_encode_corpus_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "ab", "x"), (4, "ab", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(rows).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4]
    assert got[0][1] == got[1][1] == []
    assert got[2][1]
    assert bpe.encode_corpus(rows.limit(0)).count() == 0


# p3: wrong decodings
@pytest.mark.parametrize("channel", ["cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "cp850"])
def test_utf8_read_through_tables(channel):
    text = "Überlegungen für Müdigkeit – L’été à São"
    try:
        wrong = text.encode().decode(channel)
    except UnicodeDecodeError:
        pytest.skip("the table leaves a byte open")
    restored, damaged = mojibake.examine(wrong)
    assert damaged
    assert restored == text


def test_fine_text_is_fine():
    for text in ("AVALIAÇÃO DA GESTÃO", "«СССР» и Рёбра", "A √n-consistent estimator", "„Spaß“–été", "Ä“", "Größe ≤ 5 °C ± 2 µm", "", "plain"):
        assert mojibake.examine(text) == (text, False)


def test_lost_letters_come_back(spark):
    rows = spark.createDataFrame([(1, "die Größe der Räume", ["Jörg"]), (2, "die Gr�ße", None), (2, "die Gr�ße", None), (3, None, [None, ""]), (4, "", [])], "rec_no bigint, title string, authors array<string>")
    got = sorted((r.key, r.field_name, r.restored) for r in mojibake.find_damage(rows, "rec_no", ("title", "authors")).collect())
    assert [g[:2] for g in got] == [(2, "title"), (2, "title")]
    assert got[0][2].startswith("die Gr")
    assert mojibake.find_damage(rows.limit(0), "rec_no", ("title",)).count() == 0


SCRIPTS = ["die Größe der Räume", "une étude de l’accès à l’écart", "n’ont pas été situés près de l’école", "“perinatal effects” of ageing", "Überlegungen zur Öffentlichkeitsarbeit", "Движение ледника и качество воды наблюдения в районе", "a “latent” model", "fractional porous latent perinatal ageing"] * 5


@pytest.fixture(scope="module")
def lexicon():
    from collections import Counter

    words = Counter(w for t in SCRIPTS for w in mojibake._WORD.findall(t))
    places = Counter(p for t in SCRIPTS for p in mojibake._SPECIAL_BETWEEN.findall(f" {t} "))
    batch = mojibake._counted(words, places)
    return lattice.Lexicon(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))


@pytest.mark.parametrize(
    ("damaged", "wanted"),
    [
        ("�perinatal effects of ageing", "“perinatal effects of ageing"), ("�latent and �porous", "“latent and “porous"), ("L��cart observ�", "L’écart"), ("die Gr��e der R�ume", "die Größe der Räume"), ("n�ont pas �t�", "n’ont pas été"),
        ("�ffentlichkeitsarbeit", "Öffentlichkeitsarbeit"), ("�FFENTLICHKEITSARBEIT", "ÖFFENTLICHKEITSARBEIT"), ("Gr��e", "Größe"), ("l�accès", "l’accès"),
    ],
)
def test_lost_bytes_are_restored(lexicon, damaged, wanted):
    restored, bad = mojibake.examine(damaged, lexicon)
    assert bad
    assert restored.startswith(wanted)


def test_part_of_a_character_is_lost(lexicon):
    # the second byte of "с" has no character in the table
    wrong = "ледник".encode().decode("cp1252", "replace").replace("\ufffd", "�")
    assert mojibake.examine("качество".encode().decode("cp1252", "replace"), lexicon) == ("качество", True)
    assert mojibake.examine(wrong, lexicon)[1]


@pytest.mark.parametrize(("written", "read"), channels.CONFUSED)
def test_confused_scripts(lexicon, written, read):
    text = "Движение ледника и качество воды наблюдения в районе"
    try:
        wrong = text.encode(written).decode(read)
    except UnicodeDecodeError:
        wrong = "".join(chr(b) if (c := bytes([b]).decode(read, "replace")) == "\ufffd" else c for b in text.encode(written))
    restored, bad = mojibake.examine(wrong, lexicon)
    assert bad
    assert restored.split()[:2] == ["Движение", "ледника"]
    assert mojibake.examine(text, lexicon) == (text, False)


def test_a_plain_space_after_a(lexicon):
    assert mojibake.examine("une Ã©tude Ã  l’écart et l’accÃ¨s Ã l’école", lexicon)[0] == "une étude à l’écart et l’accès à l’école"


# p4: cut texts
def test_cut_texts(spark):
    full = "Rivers rise in spring. They fall again in late summer, though slowly. Nothing else was seen."
    texts = [full, full[:40], full[:22], full.rstrip("."), full[:60] + "...", "Lakes stay the same.", None, "", "  ", "They fall again in late summer, though slowly. More was found. And then it was over."] + [f"Case {i}. Nothing else was seen. End." for i in range(4)]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "rec_no bigint, abstract string, source string")
    got = {r.key for r in truncation.find_cut(rows, "rec_no", "abstract", "source").collect()}
    assert {1, 4} <= got
    assert not got & {0, 2, 3, 5, 6, 7, 8}
    assert truncation.find_cut(rows.limit(0), "rec_no", "abstract", "source").count() == 0


def test_prefixes_against_brute_force(spark):
    keys = ["a", "ab", "abc", "b", "ba", "c", "abd", "ab", "", "bb"] + [f"k{i}" for i in range(60)] + [f"k{i}x" for i in range(0, 60, 7)]
    rows = spark.createDataFrame([(k, True) for k in keys], "text string, cand boolean")
    got = {bytes(r.digest) for r in truncation.longer_copies(rows, str).select("digest").collect()}
    want = {truncation.digest(k) for k in keys if k and any(o != k and o.startswith(k) for o in keys)}
    assert got == want


def test_endings_are_judged_by_their_share(spark):
    full = [f"Rivers of kind {i} rise. They carry in place {i} much water quality. More water quality data of station {i} follow here" for i in range(300)]
    rows = [(i, t + ".", "s") for i, t in enumerate(full)] + [(900, "Lakes were sampled and more water quality", "s"), (901, "Lakes were sampled and seen to rise", "s")]
    got = {r.key: r.evidence for r in truncation.find_cut(spark.createDataFrame(rows, "rec_no bigint, abstract string, source string"), "rec_no", "abstract", "source").collect()}
    assert 900 not in got  # half the places of these words are ends of sentences
    assert got[901] == "last words"


def test_limits_are_piles(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.randint(20, 60))) + "." for _ in range(400)]
    rows = [(i, t if i % 2 or len(t) < 200 else t[:200], None) for i, t in enumerate(texts)]
    shown = truncation.find_cut(spark.createDataFrame(rows, "rec_no bigint, abstract string, source string"), "rec_no", "abstract", "source").collect()
    assert {r.key for r in shown if r.evidence == "limit"} == {i for i, t, _ in rows if not t.endswith(".")}


def test_long_beginnings_in_common(spark):
    start = "x" * 5000
    keys = [start + f"{i:04d}" for i in range(50)] + [start + "0007tail"]
    got = {bytes(r.digest) for r in truncation.longer_copies(spark.createDataFrame([(k, True) for k in keys], "text string, cand boolean"), str).select("digest").collect()}
    assert got == {truncation.digest(start + "0007")}


# p5: reference lists
def test_reference_matcher():
    m = canon.ReferenceMatcher([(1, "Journal of Rural Virology", "1234-5678"), (2, "Quarterly Journal of Rural Virology", None), (3, "Annals of Polar Nutrition", None)])
    for value, want in (("JOURNAL OF RURAL VIROLOGY", 1), ("The Journal of Rural Virology, vol. 3(2)", 1), ("Q. J. Rural Viro.", 2), ("Polar Nutrition, Annals of", 3), ("Anals of Polar Nutritoin", 3), ("Annals of Polar Virology", 0), ("n/a", 0), ("Annalsof Polar Nutrition", 3), ("", 0), ("x" * 5000, 0)):
        assert m.find(value)[0] == want, value
    assert canon.ReferenceMatcher([]).find("anything")[0] == 0


def test_all_near_entries_are_scored():
    # more entries reach the upper bound than any fixed number of candidates
    many = [(i, f"Annals of {a} {b} Studies", None) for i, (a, b) in enumerate(((x, y) for x in ("Rural", "Polar", "Marine", "Urban", "Alpine") for y in ("Virology", "Nutrition", "Optics", "Ecology", "Robotics")), 1)]
    m = canon.ReferenceMatcher(many)
    assert [m.find(name.replace("Annals", "Anals"))[0] for _, name, _ in many] == [i for i, _, _ in many]
    assert m.find("Annals of Studies")[0] == 0
    like = canon.ReferenceMatcher([(i, f"J. of A{c} M{c}", None) for i, c in enumerate("abcdefghijklmnopqrst", 1)])
    assert like.find("J. A. M.")[0] == 0


def test_letters_bound_what_can_be_alike():
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    m = canon.ReferenceMatcher([(i, w, None) for i, w in enumerate(words, 1)])
    for t in words[:60]:
        token = t[:-1] + rng.choice("abcde")
        want = {i: v for i, w in enumerate(m.vocabulary) if (v := canon.likeness(token, w)) > 0}
        if len(token) > 2 and max(want.values(), default=0) >= canon.KNOWN:
            want = {i: v for i, v in want.items() if v >= canon.KNOWN}
        assert m._likenesses(token) == want


def test_map_values_edges(spark):
    rows = spark.createDataFrame([(1, "A B C"), (2, " A B C "), (2, " A B C "), (3, None), (4, " "), (5, "zzz")], "rec_no bigint, venue string")
    got = sorted((r.key, r.ref_id) for r in canon.map_values(rows, "rec_no", "venue", [(7, "A B C", None)]).collect())
    assert got == [(2, 7), (2, 7), (5, 0)]
    assert canon.map_values(rows.limit(0), "rec_no", "venue", []).count() == 0


# p2: names
def test_name_variants(spark):
    family = ["Priya Barvenier", "Barvenier, Priya", "P. Barvenier", "BARVENIER Priya", "Dr. Priya Barvenier", "Priya Barvernier", "Priya  Barvenier", "Ben Barvenier", "Benjamin Barvenier", "Alexander Barvenier", "Alexandra Barvenier", "A. Barvenier", "JÃ¶rg Stein", "Jörg Stein", "Jorg Stein", "Wells Imaging Study Group", "The Wells Imaging Study Group", "", " "]
    rows = spark.createDataFrame([(family,), (family,), (None,), ([None],)], "authors array<string>")
    pairs = {(r.name_a, r.name_b) for r in names.find_variants(rows, "authors").collect()}
    linked = lambda a, b: tuple(sorted((a, b))) in pairs
    assert linked("Priya Barvenier", "Barvenier, Priya")
    assert linked("P. Barvenier", "Dr. Priya Barvenier")
    assert linked("Priya Barvernier", "BARVENIER Priya")
    assert linked("Ben Barvenier", "Benjamin Barvenier")
    assert linked("JÃ¶rg Stein", "Jorg Stein")
    assert linked("Wells Imaging Study Group", "The Wells Imaging Study Group")
    assert not linked("Alexander Barvenier", "Alexandra Barvenier")
    assert not linked("A. Barvenier", "Alexander Barvenier")
    assert not linked("Priya Barvenier", "Ben Barvenier")
    assert all(a < b for a, b in pairs)
    assert names.find_variants(rows.limit(0), "authors").count() == 0


def test_chains_are_followed_to_their_end(spark):
    ids = spark.createDataFrame([(i,) for i in range(40)], "id bigint")
    up = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(30, 31)], "id bigint, up bigint")
    got = {r.id: r.root for r in names._roots(ids, up).collect()}
    assert got == {i: 29 if i < 30 else 31 if i == 30 else i for i in range(40)}


def test_long_names_are_assigned():
    import itertools

    long = "international rural imaging and soil recovery study group".split()
    assert names.alignment_cost(long, long[::-1]) == 0.0
    assert names.alignment_cost(long, [*long[:-1], "grop"]) == 1.0
    # no token serves twice
    assert names.alignment_cost(["soil", "soil", *long], ["soil", *long, "water"]) > 2.0
    a, b = ["anna", "b", "carl"], ["ana", "bert", "c", "dora"]
    brute = min(sum(names.token_cost(x, b[j]) for x, j in zip(a, p, strict=True)) + sum(0.2 if len(b[j]) == 1 else 3.0 for j in range(4) if j not in p) for p in itertools.permutations(range(4), 3))
    assert abs(names.alignment_cost(a, b) - brute) < 1e-9


def test_all_middle_initials_count(spark):
    rows = spark.createDataFrame([(["John A. B. Barvenier", "John A. C. Smesok", "J. A. B. Barvenier", "J. A. Barvenier", "J. A. B. Smesok"],)], "authors array<string>")
    pairs = {(r.name_a, r.name_b) for r in names.find_variants(rows, "authors").collect()}
    assert ("J. A. B. Barvenier", "John A. B. Barvenier") in pairs
    assert ("J. A. Barvenier", "John A. B. Barvenier") in pairs
    assert ("J. A. B. Smesok", "John A. C. Smesok") not in pairs


def test_filings_meet_near_tokens():
    import itertools

    words = ["barvenier", "smesokenko", "stein"]
    for w in words:
        for i, j in itertools.combinations(range(len(w)), 2):
            near = w[:i] + w[i + 1 : j] + w[j + 1 :]
            assert names.filings(near) & names.filings(w)


# p1: survivors
def test_survivors(spark):
    t0 = dt.datetime(2023, 1, 1)
    rows = [
        (1, 10, "Deep Rivers of the North", "Rivers rise. They fall.", "https://a.org/x/1.pdf", "publishedVersion", 5, t0),
        (1, 11, "deep rivers of the north", "Rivers rise.", "https://a.org/x/1.pdf", "publishedVersion", 9, t0 + dt.timedelta(400)),
        (1, 12, "Deep Rivers of the N...", "Rivers rise. They fall.", "https://a.org/suppl_1.pdf", None, -1, dt.datetime(2090, 1, 1)),
        (1, 13, "Untitled", None, None, None, 2147483647, None),
        (2, 20, None, "", "n/a", None, None, None),
        (2, 21, "", None, None, None, None, None),
        (3, 30, "Alone", "Text.", "https://a.org/y/3.pdf", "publishedVersion", 1, t0),
        (None, 40, "No group", None, None, None, 1, t0),
    ]
    df = spark.createDataFrame(rows, "dup_group bigint, rec_no bigint, canonical_title string, canonical_abstract string, pdf_url string, pdf_version string, citation_count bigint, updated_at timestamp")
    got = {(r.dup_group, r.field_name): r.rec_no for r in survivor.find_survivors(df).collect()}
    assert got == {(1, "canonical_title"): 10, (1, "canonical_abstract"): 10, (1, "pdf_url"): 10, (1, "citation_count"): 11}
    assert survivor.find_survivors(df.limit(0)).count() == 0


def _works(spark, rows):
    return spark.createDataFrame(rows, "dup_group bigint, rec_no bigint, canonical_title string, canonical_abstract string, pdf_url string, pdf_version string, citation_count bigint, updated_at timestamp")


def _timed(reverse: bool) -> list:
    """Works whose counts rise and whose published file is seen after the accepted one, or both the other way round."""
    t0 = dt.datetime(2023, 1, 1)
    rows = []
    for g in range(1, 60):
        for k, (count, version) in enumerate(((10, "acceptedVersion"), (30, "acceptedVersion"), (90, "publishedVersion"))):
            at = t0 + dt.timedelta(days=30 * (2 - k if reverse else k) + g % 7)
            rows.append((g, 10 * g + k, f"Work {g}", None, f"https://a.org/{version}/{g}.pdf", version, count, at))
    # without times, the learned order decides
    return rows + [(99, 990 + k, "Work 99", None, f"https://a.org/{v}/99.pdf", v, c, None) for k, (c, v) in enumerate(((10, "acceptedVersion"), (90, "publishedVersion")))]


@pytest.mark.parametrize("reverse", [False, True])
def test_reversed_times_reverse_the_order(spark, reverse):
    got = {(r.dup_group, r.field_name): r.rec_no for r in survivor.find_survivors(_works(spark, _timed(reverse))).collect()}
    assert got[5, "citation_count"] == (50 if reverse else 52)
    assert got[99, "citation_count"] == (990 if reverse else 991)
    newest = survivor.newest_time(_works(spark, _timed(reverse)), "updated_at")
    assert survivor.learn_version_order(_works(spark, _timed(reverse)), newest)[-1] == ("acceptedVersion" if reverse else "publishedVersion")


def test_counts_that_later_rows_contradict(spark):
    t0 = dt.datetime(2023, 1, 1)
    day = lambda n: t0 + dt.timedelta(days=n)
    rows = _timed(False) + [(200, 2000 + k, "Odd", None, None, None, c, t) for k, (c, t) in enumerate(((900, day(1)), (40, day(40)), (45, day(60))))]
    rows += [(300 + g, 3000 + 10 * g + k, "More", None, None, None, c, day(20 * k)) for g in range(30) for k, c in enumerate((300, 700, 950))]
    got = {(r.dup_group, r.field_name): r.rec_no for r in survivor.find_survivors(_works(spark, rows)).collect()}
    assert got[200, "citation_count"] == 2002
    assert got[300, "citation_count"] == 3002


@pytest.mark.parametrize("held", [50_000, 1])
def test_typing_errors_are_told_by_all_words(spark, monkeypatch, held):
    monkeypatch.setattr(survivor, "FREQUENT_WORDS", held)
    rows = [(g, 10 * g + k, f"The glaciers were melting when rivers rose, {'abcdefgh'[g] * 5}", None, None, None, None, None) for g in range(8) for k in range(2)]
    # transpositions, a letter too many, and a word that is no error since two works have it
    wrong = [(20, "When the glacires rose"), (21, "Melting wehre rivers rise"), (22, "Rivers risse"), (23, "Glaciers metling risse")]
    rows += [(g, 10 * g + k, t, None, None, None, None, None) for g, t in wrong for k in range(2)]
    got = {r.dup_group for r in survivor.find_survivors(_works(spark, rows)).where("field_name = 'canonical_title'").collect()}
    assert got == {*range(8), 22}


@needs_data
def test_words_held_or_joined_tell_the_same(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/enriched_records.parquet")
    want = set(survivor.find_survivors(rows).collect())
    monkeypatch.setattr(survivor, "FREQUENT_WORDS", 20)
    assert set(survivor.find_survivors(rows).collect()) == want


def test_abstract_that_opens_with_stock_words(spark):
    text = "No abstract available. " + "See full text article. " * 6 + "Rivers rise in spring."
    got = survivor.find_survivors(_works(spark, [(1, 1, "Rivers", text, None, None, None, None), (1, 2, "Rivers", "No abstract available", None, None, None, None)])).collect()
    assert {(r.field_name, r.rec_no) for r in got} == {("canonical_title", 1), ("canonical_abstract", 1)}


# p6: matching
def test_match_rules():
    base = matchrules.Described("Does urban soil respiration affect distributed sensor networks?", ["A. Virnares"], 2003, "Q J Indus Catal")
    score = lambda *other: matchrules.confidence(c) if (c := matchrules.compare(base, matchrules.Described(*other))) else -9.0
    assert score("Does urban sol respiration affeect distributed sensor networks?", ["Alexandra Virnares"], 2003, "Quarterly Journal of Industrial Catalysis") > 0
    assert score("Reply to comments on Xy: Does urban soil respiration affect distributed sensor networks?", ["Alexandra Virnares"], 2005, None) < 0
    assert score("Does marine soil recovery affect distributed sensor networks?", ["Alexandra Virnares"], 2003, None) < 0
    assert score(None, None, None, None) < 0


@needs_data
@pytest.mark.parametrize(("directory", "every"), [(DATA, 1), ("/root/testdata/sf0.01", 4)])
def test_candidates_against_brute_force(spark, directory, every):
    left, right = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("oa_records", "repo_records"))
    cols = ["rec_no", "title", "authors", "pub_year", "venue"]
    a, b = ([(r.rec_no, matchrules.Described(*r[1:])) for r in t.select(*cols).collect()] for t in (left, right.where(F.col("rec_no") % every == 0)))
    want = {(i, j) for j, y in b for i, x in a if (c := matchrules.compare(y, x)) and matchrules.confidence(c) > 0}
    got = {(r.rec_no, r.repo_rec_no) for r in matching.candidates(left, right).collect()}
    assert len(want & got) >= 0.95 * len(want)


@needs_data
def test_match_edges(spark):
    left, right = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("oa_records", "repo_records"))
    assert matching.find_matches(left.limit(0), right).count() == 0
    assert matching.find_matches(left, right.limit(0)).count() == 0


@needs_data
def test_matching_broadcasts_no_table(spark, monkeypatch):
    left, right = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("oa_records", "repo_records"))
    seen, stage = [], matching.staged
    monkeypatch.setattr(matching, "staged", lambda df: seen.append(df) or stage(df))
    seen.append(matching.find_matches(left, right))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 2 and not any("BroadcastExchange" in p for p in plans)


@needs_data
def test_vectors_are_trained(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/oa_records.parquet").select("title", "authors", "pub_year", "venue").collect()
    sample = [matching.graph_tokens(*r) for r in rows]
    losses: list[float] = []
    vectors = matching.train_vectors(sample, losses=losses)
    assert losses[-1] < 0.92 * losses[0]
    start = np.random.default_rng(matching.SEED).standard_normal((matching.SLOTS, matching.WIDTH)).astype(np.float32)
    start /= np.linalg.norm(start, axis=1, keepdims=True)
    seen = sorted({matching.slot(t) for r in sample for t in r})
    assert (vectors[seen] * start[seen]).sum(axis=1).mean() < 0.9
    assert matching.train_vectors([]).shape == vectors.shape


def test_confidence_is_calibrated_on_perturbed_records():
    import numpy as np

    rng = np.random.default_rng(4)
    syllables = ["ka", "ro", "vin", "tel", "mo", "sup", "dra", "lin"]
    word = lambda: "".join(rng.choice(syllables, 3))
    sample = [(f"Effects of {word()} on {word()} near {word()}", [f"{word().title()} {word().title()}"], int(rng.integers(1990, 2020)), "Soil Letters") for _ in range(300)]
    model = matching.RecordVectors(matching.train_vectors([matching.graph_tokens(*r) for r in sample], rounds=2), {}, 300, 6)
    by_cosine, by_score, offset = matching.calibrate(model, sample)
    sure = lambda cosine, score: 1 / (1 + np.exp(-(by_cosine * cosine + by_score * score + offset)))
    assert sure(0.95, 4.0) > 0.9
    assert sure(0.3, -2.0) < 0.1


def test_ninety_authors():
    many = [f"Person{i:02d} Number{i:02d}" for i in range(90)]
    persons = [([f"person{chr(97 + i % 26)}{chr(97 + i // 26)}x", f"number{chr(97 + i % 26)}{chr(97 + i // 26)}y"], []) for i in range(90)]
    assert matchrules.author_agreement(persons, persons[::-1]) == 1.0
    half = persons[:45] + [([f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}qwk"], []) for i in range(45)]
    assert matchrules.author_agreement(half, persons) == 0.5
    assert len(matching.record_tokens(None, many)[1]) == 180


def test_words_that_are_in_both_titles_tell_nothing():
    base = matchrules.Described("The Nugesk dataset: seasonal drought response in sandstone aquifers", ["C. Vesildonen"], 2019, None)
    cut = matchrules.Described("The Nugesk dataset: seasonal drought respon...", ["Christina Vesildonen"], 2019, None)
    assert matchrules.confidence(matchrules.compare(cut, base)) > 0
    other = matchrules.Described("Reply to: The Nugesk dataset: seasonal drought response in sandstone aquifers", ["Otto Kram"], 2020, None)
    assert (c := matchrules.compare(other, base)) is None or matchrules.confidence(c) < 0


def test_titles_that_many_rows_share_need_authors():
    a = matchrules.Described("Introduction to the special issue", None, 2006, "Annals of Rural Epidemiology")
    c = matchrules.compare(a, a)
    assert matchrules.confidence(c) > 0
    assert matchrules.confidence(c, 5_000) < 0


@pytest.mark.parametrize("rows", [2_400, 240_000, 24_000_000])
def test_near_records_meet_at_every_size(rows):
    import numpy as np

    bits = matching.index_bits(rows)
    index = matching.RecordVectors(np.zeros((1, matching.WIDTH), np.float32), {}, rows, bits)
    rng = np.random.default_rng(3)
    x, z = rng.standard_normal((2, 1500, matching.WIDTH)).astype(np.float32)
    turn = np.pi * 25 / matching.SKETCH
    y = np.cos(turn) * x + np.sin(turn) * z
    filed, looked = index.buckets(x @ index.planes, False), index.buckets(y @ index.planes, True)
    met = [np.isin(a, b).any() for a, b in zip(filed, looked, strict=True)]
    assert np.mean(met) >= 0.93


def test_mistyped_titles_stay_candidates(spark):
    names_ = ["Karvolin", "Bestrupak", "Ommizand", "Tulgorev", "Wexaphil", "Dranosky", "Hublinter", "Ysorvant", "Quillemor", "Fjandreth", "Pembrusc", "Zothalin"]
    kind = "rec_no bigint, title string, authors array<string>, pub_year int, venue string"
    left = [(i, f"Effects of urban soil recovery on {n} in catalogue records", [f"Alba {n[::-1]}", f"Otto {n[2:]}berg"], 2001, "Soil Letters") for i, n in enumerate(names_)]
    left += [(50, "Molten Glacier Hymns", ["Ada Brunswijk"], 1999, None), (51, "A trial of many hands", [f"Person Number{i:03d}" for i in range(300)], 2010, None)]
    right = [(100 + i, f"Effects of urban soil recovery on {n[:2] + n[3:]} in catalogue records", [], 2001, None) for i, n in enumerate(names_)]
    right += [(150, "Moltn Glacier Hymns", ["Brunswijk, Ada"], 1999, None), (151, "A trial of many hands", [f"Person Number{i:03d}" for i in range(299, -1, -1)], 2010, None)]
    got = {(r.rec_no, r.repo_rec_no) for r in matching.candidates(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)).collect()}
    assert {(r[0], r[0] + 100) for r in left} <= got


def test_a_batch_learns_its_tokens_at_once(monkeypatch):
    import math

    import numpy as np
    import xxhash

    vectors = np.random.default_rng(6).standard_normal((matching.SLOTS, matching.WIDTH)).astype(np.float32)
    index = matching.RecordVectors(vectors, {"soil": 40, "ada": 7}, 300, 6)
    calls, learn = [], matching.RecordVectors.learn
    monkeypatch.setattr(matching.RecordVectors, "learn", lambda self, tokens, author: calls.append(author) or learn(self, tokens, author))
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(f"Soil {w} of Überlingen", ["Ada Lovelace", None, "", f"Ida {w}berg"]) for w in words] + [(None, None), ("", [])]
    for _ in range(2):
        unit, masks = index.vectors_of(rows)
        assert calls == [False, True] * (len(calls) // 2) and unit.shape == (66, matching.WIDTH) and not unit[-2:].any() and not masks[-2:].any()
    for author, size, tokens in ((0, matching.TITLE_BITS, ["soil", "uberlingen", *words]), (1, matching.AUTHOR_BITS, ["ada", "lovelace", *(f"{w}berg" for w in words)])):
        for t in tokens:
            parts = matching.trigrams(t)
            rest = sum(vectors[matching.slot("3:" + x)].astype(np.float64) for x in parts)
            want = 0.6 * vectors[matching.slot("a:" + t if author else t)] + 0.8 * rest / math.sqrt(rest @ rest)
            at = index.at[author][t]
            assert np.allclose(index.known[at], want * math.log(1 + 300 / index.frequency.get(t, 1)) ** matching.RARITY, atol=1e-4)
            bits = sum(int(x) << 64 * k for k, x in enumerate(index.bits_of[at].view(np.uint64)))
            assert bits == sum(1 << b for b in {xxhash.xxh3_64_intdigest(x) % size for x in parts})


def test_tokens_are_counted_without_a_pattern_for_each_row(spark):
    odd = "Alpha beta\tGAMMA\n“alpha”: beta–delta_…¿epsilon!\u00a0zeta\x0beta\x0ctheta\riota [kappa] l’amour \\ ^mu"
    rows = spark.createDataFrame([(odd, ["Ada Lovelace", None, "Noether, Emmy"]), (odd, None), (None, ["Ada O'Hara"]), (None, None)], "title string, authors array<string>")
    both = F.lower(F.concat_ws(" ", "title", F.array_join("authors", " ")))
    want = rows.select(F.explode(F.array_distinct(F.split(both, r"[\s\p{Punct}“”‘’«»„‚‹›…¿¡–—]+"))).alias("t")).where("t <> ''").groupBy("t").count().where("count > 1").collect()
    assert matching.token_frequency(rows) == {names.fold(r.t): r["count"] for r in want}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edits_without_shared_ends(most):
    from itertools import product

    words = ["".join(w) for n in range(6) for w in product("ab", repeat=n)] + ["abcab", "bacab", "cabab", "abccba"]
    for a, b in product(words, repeat=2):
        assert min(matchrules.edits(a, b, most), most + 1) == min(canon.edits(a, b, most), most + 1)
        if canon.edits(a, b, most) <= most:
            assert (matchrules._letters(a) ^ matchrules._letters(b)).bit_count() <= 2 * most


# p8: mixing
def test_capped_shares():
    got = mixing.capped_shares({"a": 0.5, "b": 0.5, "none": 0.2}, {"a": 10.0, "b": 1000.0}, 100.0)
    assert got["a"] == 10.0
    assert abs(got["b"] - 90.0) < 1e-6
    assert got["none"] == 0.0


def test_mix(spark):
    docs = [(i, f"word{i} " * (5 + i % 7), ["en", "de", None][i % 3], "big" if i % 4 else "small", "k") for i in range(400)] + [(900, None, "en", "big", "k"), (901, "", "en", "big", "k"), (902, "x", "en", None, "k")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, doc_kind string")
    plans = spark.createDataFrame([("p", "big", 0.5, 1, 0.4), ("p", "small", 0.5, 2, 0.4), ("p", "absent", 0.1, 2, 0.4)], "plan_name string, source string, target_share double, max_repeats int, size_ratio double")
    mix = mixing.find_mix(d, plans)
    rows = mix.collect()
    most = {"big": 1, "small": 2}
    assert rows
    assert all(1 <= r.copies <= most[r.source] for r in rows)
    share = {r.source: r.reached_share for r in rows}
    assert abs(share["big"] - 0.5) < 0.06
    assert mixing.find_mix(d, plans.limit(0)).count() == 0


def test_a_draw_that_misses_by_far_ends(spark):
    docs = spark.createDataFrame([(i, 10.0**10) for i in range(6)], "far int, n double")
    bins = docs.agg(F.array_sort(F.collect_list(F.struct("far", "n"))).alias("bins")).withColumn("miss", F.lit(2.4e10))
    reach = "aggregate(bins, named_struct('sum', 0D, 'far', -1, 'over', false), (s, b) -> if(not s.over and s.sum + b.n <= abs(miss) + b.n / 2, named_struct('sum', s.sum + b.n, 'far', b.far, 'over', false), named_struct('sum', s.sum, 'far', s.far, 'over', true))).far"
    import inspect

    assert reach in inspect.getsource(mixing.find_mix)
    assert bins.select(F.expr(reach).alias("far")).collect()[0].far == 1


def test_raking_holds_sources_and_caps():
    tokens = {(s, la, k): 100.0 + 10 * i for i, (s, la, k) in enumerate((s, la, k) for s in "ab" for la in ("en", "de") for k in ("x", "y"))}
    goal = {"a": 150.0, "b": 500.0}
    got = mixing.rake(tokens, goal, {"a": 1.0, "b": 1.0})
    by = {s: sum(w for c, w in got.items() if c[0] == s) for s in "ab"}
    assert abs(by["a"] - 150.0) < 1e-6
    assert abs(by["b"] - 500.0) < 1e-6
    assert all(w <= tokens[c] + 1e-9 for c, w in got.items())
    assert mixing.rake(tokens, {}, {}) == {}


# p9: residue
@needs_data
def test_residue(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    cases = [
        (-1, "Please enable JavaScript in your browser to view this article.", True), (-2, "Deep rivers\n{{abstract}}", True), (-3, "The survey asked readers whether the notice “Please enable JavaScript” stopped them from using repositories; 5 % said yes.", False),
        (-4, "We compare template engines that replace slots such as {{title}} or ${author} when catalogue cards are printed.", False), (-5, "Samples were kept at 5 °C and measured every [INSERT UNIT HERE] by two teams.", True), (-6, "", False), (-7, None, False), (-8, "  \n", False),
        (-9, "asdf asdf asdf asdf asdf asdf asdf asdf", True), (-10, '{"status":503,"error":"Service Unavailable"}', True), (-11, "Let $\\frac{{a}}{b}$ and $x_{[[k]]}$ be given; then the estimator is unbiased.", False),
    ]
    rows = docs.unionByName(spark.createDataFrame([(k, t) for k, t, _ in cases], "doc_id bigint, text string"))
    found = residue.find_residue(rows, "doc_id", "text")
    got = {r.key for r in found.where("key < 0").collect()}
    assert got == {k for k, _, bad in cases if bad}
    assert residue.without_residue(rows, found, "doc_id").where(F.col("doc_id").isin(*[k for k, _, bad in cases if bad])).count() == 0


def test_grams_of_many_texts():
    import numpy as np

    texts = ["Rivers rise  in 1990.", "a", "Überall Nebel", "x y z"]
    assert np.array_equal(residue.grams_of(texts), np.concatenate([residue.grams(residue.plain(t)) for t in texts]))


@needs_data
def test_residue_that_a_third_of_the_rows_repeat(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    page = "Sorry, an unexpected error occurred while loading this record."
    n = docs.count() // 4
    pages = [(-1 - i, page) for i in range(n)] + [(-1 - n - i, f"Soil recovery near river {chr(97 + i)}ornau\n{page}") for i in range(n)]
    rows = docs.unionByName(spark.createDataFrame(pages, "doc_id bigint, text string"))
    assert residue.find_residue(rows, "doc_id", "text").where("key < 0").count() == len(pages)


@needs_data
def test_windows_do_not_depend_on_what_stands_beside(spark):
    import numpy as np

    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect() if r.text and r.text.strip()]
    model = residue.ResidueModel(np.bincount(residue.grams_of(texts), minlength=1 << residue.BITS))
    together = model.windows(texts)
    assert together == [model.windows([t])[0] for t in texts]
    assert any(together)
    long = "Rivers rise in spring and fall in autumn. " * 30_000 + "\nPlease enable JavaScript to view this article."
    assert [k for _, k in model.windows([long])[0]] == ["line"]


@needs_data
def test_least_coverage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    all_, most = residue.find_residue(docs, "doc_id", "text"), residue.find_residue(docs, "doc_id", "text", least=0.5)
    assert {r.key for r in most.collect()} == {r.key for r in all_.collect() if r.coverage >= 0.5}


# what breaks naive forms, for every operator
CLASH = ("key", "text", "n", "name", "value", "core", "grp", "part", "tail", "place", "source_", "bucket", "buckets", "score", "cosine", "confidence", "id_", "root", "file", "size", "evidence", "restored", "sure", "words", "copies", "draw", "line", "slice")
LONG = "Rivers rise in spring and fall in autumn, " * 5_000


def _odd(spark, shape, rows):
    """Rows, each twice, a row of nulls, and columns whose names operators might use themselves."""
    df = spark.createDataFrame([*rows, *rows, tuple([None] * len(rows[0]))], shape)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


def test_odd_tables_survivors(spark):
    shape = "dup_group bigint, rec_no bigint, canonical_title string, canonical_abstract string, pdf_url string, pdf_version string, citation_count bigint, updated_at timestamp"
    rows = _odd(spark, shape, [(1, 1, "Rivers", LONG, "https://a.org/1.pdf", None, 5, None), (1, 2, "", None, "", "", -1, None), (2, 3, None, "  ", None, None, None, None)])
    got = {(r.dup_group, r.field_name): r.rec_no for r in survivor.find_survivors(rows).collect()}
    assert got[1, "canonical_title"] == 1
    assert got[1, "citation_count"] == 1
    assert not any(g == 2 for g, _ in got)


def test_odd_tables_names(spark):
    rows = _odd(spark, "rec_no bigint, authors array<string>", [(1, ["Ada Lovelace", None, "", " ", "A" * 5_000, "Lovelace, Ada", "Ada Lovelace"]), (2, [])])
    got = [(r.name_a, r.name_b) for r in names.find_variants(rows, "authors").collect()]
    assert got == [("Ada Lovelace", "Lovelace, Ada")]


def test_odd_tables_damage(spark):
    rows = _odd(spark, "rec_no bigint, title string, abstract string, authors array<string>", [(1, "GrÃ¶ÃŸe", LONG, [None, ""]), (2, "", "  ", []), (3, "a" + "é" * 50_000, None, None)])
    got = sorted((r.key, r.field_name) for r in mojibake.find_damage(rows, "rec_no", ("title", "abstract", "authors")).collect())
    assert got == [(1, "title"), (1, "title")]


def test_odd_tables_cuts(spark):
    rows = _odd(spark, "rec_no bigint, abstract string, source string", [(1, LONG + "and so they go on.", None), (2, LONG + "and so", None), (3, "", "s"), (4, "  ", "s")])
    cut = truncation.find_cut(rows, "rec_no", "abstract", "source")
    assert sorted(r.key for r in cut.collect()) == [2, 2]
    assert {r.source: r.n_texts for r in truncation.report(rows, cut.distinct(), "rec_no", "abstract", "source").collect()} == {None: 4}


def test_odd_tables_values(spark):
    rows = _odd(spark, "rec_no bigint, venue string", [(1, "Anals of Rural Optics"), (2, ""), (3, "x " * 20_000)])
    got = sorted((r.key, r.ref_id) for r in canon.map_values(rows, "rec_no", "venue", [(7, "Annals of Rural Optics", None)]).collect())
    assert got == [(1, 7), (1, 7), (3, 0), (3, 0)]


def test_odd_tables_matching(spark):
    shape = "rec_no bigint, id string, doi string, title string, authors array<string>, pub_year int, venue string"
    many = [(10 + i, f"x:{i}", None, f"On the {w} of glaciers near Port {w.title()}", [f"Ida {w.title()}son"], 2000 + i, None) for i, w in enumerate(("colour", "breath", "weight", "hunger", "thirst"))]
    left = _odd(spark, shape, [*many, (1, "x:a", "10.1/a", "Deep rivers of the north", ["Ada Lovelace", None], 2001, "Annals"), (2, "x:b", "doi:10.1/A", "", [], None, None), (3, "x:c", None, LONG, None, 0, "")])
    right = _odd(spark, shape.replace("id string, doi string, ", ""), [(100, "Deep rivers of teh north", ["A. Lovelace"], 2001, None), (101, "", [], None, None), (102, None, None, None, None)])
    got = sorted({(r.rec_no, r.repo_rec_no) for r in matching.find_matches(left, right).collect()})
    assert got == [(1, 100), (2, 100)]


def test_odd_tables_mixing(spark):
    shape = "doc_id bigint, text string, lang string, source string, doc_kind string"
    docs = _odd(spark, shape, [(1, "one two three", None, "a", None), (2, "", "en", "a", "k"), (3, LONG, "en", "b", "k")])
    plans = spark.createDataFrame([("p", "a", 0.5, 2, 1.0), ("p", "b", 0.5, 1, 1.0), (None, "a", 0.5, 1, 1.0), ("p", None, 0.5, 1, 1.0)], "plan_name string, source string, target_share double, max_repeats int, size_ratio double")
    mix = mixing.find_mix(docs, plans)
    assert {r.doc_id for r in mix.collect()} <= {1, 3}
    assert mixing.shares(mix, plans, mixing.count_tokens(docs, "text", ("doc_id", "source"))).count() == 4
    sized = mixing.count_tokens(docs, "text", ("doc_id", "source", "lang", "doc_kind"))
    assert mixing.margins(mix, sized).where("margin = 'lang'").count() >= 1


def test_odd_tables_residue(spark):
    rows = _odd(spark, "doc_id bigint, text string", [(1, "Please enable JavaScript to view this article."), (2, ""), (3, " \\n "), (4, LONG)])
    got = sorted(r.key for r in residue.find_residue(rows, "doc_id", "text").collect())
    assert got in ([1, 1], [])  # so few texts are hardly a corpus; nothing else may come out
