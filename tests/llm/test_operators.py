"""The corpus operators against brute force, exact round trips and awkward rows."""

import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter
from itertools import combinations, pairwise

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, katz, licenses, lines, ngram_join, quality, queries, sharding, urls, winnow

import katz_plain  # noqa: E402
from sluice.session import BATCH_CONF  # noqa: E402

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen"
NEAR = " ".join(f"n{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, n int, root long, class string, row string"
TEXTS = [
    (1, SAME), (2, SAME), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, SAME), (7, SAME), (8, "short"), (9, "<|endoftext|> ünï 漢字 😀"),
    (None, "no id but quite some words in this very line"), (None, None), (10, NEAR), (11, NEAR + " more"), (12, NEAR + "\n" + NEAR + " words"),
    (13, "Licensed under CC BY-NC 4.0. All rights reserved"), (14, "It is under the GNU General Public License, version 3"), (15, "cc by cc by"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None, "src0", None if t is None else len(t), "x", 1, 2, "y", "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(2, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SAME), (2, "short"), (3, None), (4, ""), (None, "漢字"), (1, SAME), (5, NEAR + " x")], "item_id long, text string")


def by_text(df):
    """Rows of an operator in the order of TEXTS can't be told by id alone; ids suffice for those asked."""
    return {r["doc_id"]: r for r in df.collect()}


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(ids.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_join_matches_brute_force(spark, awkward):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.report(awkward).collect())
    assert got == brute_components(TEXTS)


def test_trees_find_every_link(spark):
    """Chains of edits around the threshold, where near copies don't all link with their bucket's first."""
    rng = random.Random(7)
    rows, base = [], [f"v{i}" for i in range(120)]
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"u{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.report(docs).collect())
    assert got == brute_components(rows)


def test_one_of_a_group_stays(awkward):
    kept = sorted(str(r["doc_id"]) for r in ngram_join.keep_first(awkward).collect())
    assert "1" in kept and "2" not in kept and "7" not in kept and kept.count("None") == 2 and {"3", "4", "5"} <= set(kept)
    assert ngram_join.keep_first(awkward).columns == awkward.columns


def test_model_matches_plain_python(spark, awkward):
    expected, probability, known = katz_plain.scores(TEXTS)
    got = [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz.score(awkward).collect()]
    for a, b in zip(sorted(got), sorted(expected)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)
    for history in ("start", b"w1", b"one"):
        assert math.isclose(sum(probability(history, w) for w in known) + probability(history, b"never seen"), 1.0, rel_tol=1e-9)


def test_fingerprints_keep_every_window(spark, awkward):
    got = by_text(winnow.fingerprints(awkward))
    place = [f["position"] for f in got[6]["fingerprint"]]
    assert place == sorted(place) and place[0] < 8 and max(b - a for a, b in pairwise(place)) <= 8
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[4]["fingerprint"] == [] and len(got[8]["fingerprint"]) == 1


def plain_winnow(text):
    """(hash, position) by the definition: every window of 8 grams of 5 characters, its smallest hash, rightmost."""
    codes = [ord(c) for c in re.sub(r"[ \t-\r]+", "", text or "").lower().replace("ς", "σ")]
    prime, base = (1 << 31) - 1, 1_000_003

    def rolled(run):
        if len(run) == 5:  # four rolled up from pairs, then the last one
            four = rolled(run[:2]) * pow(base, 2, prime) % prime + rolled(run[2:4])
            return four * base % prime + run[4]
        value = run[0] if len(run) == 2 else 0
        for c in run[len(run) == 2 :]:
            value = value * base % prime + c
        return value

    runs = [codes[i : i + 5] for i in range(len(codes) - 4)] if len(codes) >= 5 else [codes] if codes else []
    hashed = [xxhash.xxh64_intdigest(rolled(r).to_bytes(8, "little", signed=True), 42) for r in runs]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashed]
    tops = [(h >> 31, -i) for i, h in enumerate(signed)]
    found = {min(tops[i : i + 8]) for i in range(max(1, len(tops) - 7))} if tops else set()
    return sorted(((h % (1 << 33), -i) for h, i in found), key=lambda x: x[1])


def plain_report(rows):
    """What the edits give, by brute force, for distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        prints = [plain_winnow(t) for t in (text, edited, after)]
        own, changed, following = ({h for h, _ in p} for p in prints)
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        spelt = [" ".join(f"{h:X}@{p}" for h, p in f) for f in prints[:2]]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *spelt, near(own, changed), near(own, following))
    return out


def test_fingerprints_match_brute_force(spark):
    draw = random.Random(3)
    letters = "ab \nΣσİ漢😀é\t"
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 4, 5, 8, 11, 12, 13, 15, 16, 17, 20, 40, 300])))) for i in range(150)]
    rows += [(1000, None), (1001, "x" * 500), (1002, " " * 40), (1003, "abcdefghijkl" + " " * 4), (-5, LONG[:3000])]
    got = winnow.against_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == plain_report(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, SAME)] * 50 + [(2, NEAR), (2, "other text of the same id"), (None, "without an id")]
    got = winnow.against_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 50, 2: 2, None: 1} and len({tuple(r) for r in got}) == 4


def test_rightmost_of_equal_hashes(spark):
    text = " ".join(["a"] * 20)  # 16 equal grams, 9 windows of 8
    row = winnow.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [f["position"] for f in row["fingerprint"]] == list(range(7, 16))


def test_edits(spark):
    rows = [(1, "abcdefgh"), (5, "漢字x"), (3, SAME)]
    got = by_text(winnow.against_edits(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1]["edited_sha256"] == hashlib.sha256(("abcdef" + SAME[:2]).encode()).hexdigest()
    assert got[5]["edited_sha256"] == hashlib.sha256("漢字x".encode()).hexdigest() and got[5]["near_edited"] == 1.0


def test_edits_by_characters(spark):
    unspaced = "".join(chr(0x4E00 + 37 * i % 4000) for i in range(80))
    words = [f"plain{i}" for i in range(40)]
    scattered = " ".join("x" if i % 4 == 3 else w for i, w in enumerate(words))
    rows = [(1, "five words are all here"), (2, unspaced), (3, " ".join(words)), (4, scattered)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_text(winnow.against_edits(docs))
    assert got[1]["near_edited"] > 0.3 and got[2]["near_edited"] > 0.4
    assert got[3]["near_next"] > 0.4  # every fourth word is another


def test_edits_of_awkward_rows(awkward):
    assert winnow.against_edits(awkward).count() == len(TEXTS)


def brute_hits(text, windows):
    words = decontaminate.alnum_words((text or "").encode())
    hit, found = set(), set()
    for item, window in windows:
        for i in range(len(words) - len(window) + 1):
            if words[i : i + len(window)] == window:
                hit |= set(range(i, i + len(window)))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_decontamination_matches_brute_force(awkward, items, block_words):
    windows = []
    for r in items.collect():
        words = decontaminate.alnum_words((r["text"] or "").encode())
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.append(("" if r["item_id"] is None else str(r["item_id"]), words[i : i + 10]))
    rows = decontaminate.scan(awkward, items, block_words=block_words).select("text", f"{decontaminate.FOUND}.*").collect()
    for r in rows:
        ends = list(r["spans"])
        assert (r["n_words"], sum(ends[1::2]) - sum(ends[::2]), list(r["items"])) == brute_hits(r["text"], windows)


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, f"Begin here: {SAME}. And so many other words, that it stays on and on, in full as it is!", 1)], "doc_id long, text string, n_chars long")
    out = decontaminate.clean(docs, spark.createDataFrame([(1, SAME.upper())], "item_id long, text string")).first()
    assert out["text"] == "Begin here: . And so many other words, that it stays on and on, in full as it is!" and out["n_chars"] == len(out["text"])


def test_cutting_takes_one_worker_a_task(awkward, items, capsys):
    decontaminate.clean(awkward, items).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_cut_after_the_last_block(awkward, items):
    kept = lambda block_words: decontaminate.scan(awkward, items, block_words=block_words, cut=True).select("text", f"{decontaminate.FOUND}.*").collect()
    assert sorted(map(str, kept(5))) == sorted(map(str, kept(500_000)))
    for r in kept(5):
        spans = [list(p) for p in zip(r["spans"][::2], r["spans"][1::2])]
        assert r["kept"] == (decontaminate.without(r["text"].encode(), spans).decode() if spans else None)


def test_hosts_and_rules(spark, labels):
    urls_seen = ["http://A.example.NET/en/1?x", "https://b.net/x", "http://example.com/de/2#t", "x.org/fr/", None, "http://s.org/fr/3", "ftp://h", "http://net/", "http://a.b/en/4?://c"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls_seen)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.page_outcomes(pages, labels)).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("b.net", "/x", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[7] == ("net", "/", "net/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[6][:3] == ("h", "", None) and got[8][:2] == ("a.b", "/en/4")


def test_bad_hosts_are_blocked(spark):
    counts = spark.createDataFrame([("bad.example", 40, 39)] + [(f"h{i}.site{i % 5}.test", 30, 3) for i in range(30)] + [("new.site1.test", 0, 0)], "host string, n long, bad long")
    got = {r["host"]: r for r in urls.reputation(counts).collect()}
    assert got["bad.example"]["lower"] > 0.5 and got["h1.site1.test"]["lower"] < 0.2 and 0.05 < got["new.site1.test"]["estimate"] < 0.3


def test_beta_quantile():
    import numpy as np

    # beta(1, b) and beta(a, 1) have closed quantiles
    assert np.allclose(urls.beta_quantile(0.05, np.array([1.0, 7.0]), np.array([9.0, 1.0])), [1 - 0.95 ** (1 / 9), 0.05 ** (1 / 7)], atol=1e-9)


def test_bpe_equals_the_library(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_file())
    own = bpe.encode(awkward, queries.vocabulary_file(), "ids")
    for r in bpe.decode(own, queries.vocabulary_file(), "ids").collect():
        assert list(r["ids"]) == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    digests = by_text(bpe.digest(awkward, queries.vocabulary_file()))
    assert digests[4]["n_tokens"] == 0 and digests[9]["decoded_sha256"] == hashlib.sha256(TEXTS[9][1].encode()).hexdigest()


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, known).where("held_out").join(known, "doc_id").where("quality IS NOT NULL").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_quality_of_awkward_rows(awkward, labels):
    rows = quality.score(awkward, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in quality.score(awkward, labels.where("false")).collect()] == [0.5] * len(TEXTS)


def test_shards_are_contiguous_and_even(spark, sf_dir, awkward):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), awkward):
        rows = sharding.shards(docs).collect()
        assert len(rows) == docs.count()
        for shard in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
        sizes = Counter()
        for r in rows:
            sizes[r["shard"]] += r["size"]
        assert max(abs(s - sum(sizes.values()) / 40) for s in sizes.values()) <= max(r["size"] for r in rows)
        ordered = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["shard"]) for r in rows)
        assert [s for _, s in ordered] == sorted(s for _, s in ordered)
    assert by_text(sharding.shards(awkward))[8]["text_crc32"] == zlib.crc32(b"short")


def test_shards_by_brute_force(spark, sf_dir):
    """Every column of every row from running sums in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], zlib.crc32(t), len(t) + 16) for r in docs.select("doc_id", "text").collect() for t in [(r["text"] or "").encode()])
    whole, upto, slots, expected = sum(size for _, _, size in rows), 0, Counter(), []
    for doc_id, crc, size in rows:
        shard = (2 * upto + size) * 40 // (2 * whole)
        expected.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        upto += size
        slots[shard] += 1
    got = sharding.shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == expected


def test_licence_base_by_brute_force(spark, sf_dir):
    """The base columns of every document from a plain walk over its words."""
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        expected[r["doc_id"]] = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))
    got = licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected and any(e[1] for e in expected.values())


def test_licences(awkward):
    got = by_text(licenses.scan(awkward))
    assert (got[13]["base_labels"], got[13]["labels"], got[13]["n_base"]) == ("cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 2)
    assert (got[14]["base_labels"], got[14]["first_word"], got[14]["last_word"]) == ("gpl", 5, 5)
    assert (got[15]["n_base"], got[15]["first_word"], got[15]["last_word"]) == (2, 0, 2) and got[4]["score"] == 0.0


def test_lines(spark):
    line = "a line of some words that is long enough to count as one"
    near = line.replace("some", "any") + " among others that follow it in the same very long line of words, and so on and on and on"
    rows = [(1, f"{line}\nhead\n{near}"), (2, f"{line}\nhead\nits own line that no other document has got"), (3, near + " x"), (4, None), (5, "head"), (2, f"{line}\nhead\nits own line that no other document has got")]
    got = sorted((r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("text IS NOT NULL").collect())
    own = "its own line that no other document has got"
    assert got == [(1, f"{line}\nhead\n{near}"), (2, own), (2, own)]


def kept_lines(spark, rows):
    return sorted((r["doc_id"], r["text"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_lines_by_character_shingles(spark):
    words = "one changed letter in ten words of a rather plain sentence that goes on for long"
    unspaced = "".join(chr(0x4E00 + 37 * i % 4000) for i in range(80))
    rows = [(1, words), (2, words.replace("plain", "plaid")), (3, unspaced), (4, unspaced[:30] + "x" + unspaced[30:]), (5, "menu: home"), (6, "menu: home"), (7, "menu: work")]
    assert kept_lines(spark, rows) == [rows[0], rows[2], rows[4], rows[6]]


def test_short_and_padded_lines(spark):
    """Equal lines of any length go but for the first; white space at their ends doesn't count, blank lines stay."""
    rows = [(1, "}\nabcdef\n\nhead"), (2, "\tabcdef\r\n}\nab\n\n x"), (3, "  AB\t\nhea"), (4, "HEAD\r\n}"), (5, "\n"), (6, "漢字"), (7, "漢字\n字")]
    assert kept_lines(spark, rows) == [rows[0], (2, "ab\n\n x"), (3, "hea"), rows[4], rows[5], (7, "字")]


def test_lines_of_crowded_buckets(spark, monkeypatch):
    """Families of near copies in the same buckets, whatever bands they share: as many links as by brute force."""
    draw = random.Random(7)
    stem = [draw.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(draw.randrange(100)) for _ in range(30)]
    texts = set()
    for family in range(12):
        own = stem[:18] + [f"own{family}x{i}" for i in range(8)] + stem[18:]
        for _ in range(12):
            words = list(own)
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            texts.add(" ".join(words))
    texts = sorted(texts)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    monkeypatch.setattr(lines, "band_keys", lambda line: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(lines, "BLOCK", 20)
    assert kept_lines(spark, list(enumerate(texts))) == [(i, texts[i]) for i in sorted(set(root))]
    monkeypatch.undo()
    got = kept_lines(spark, list(enumerate(texts)))
    assert len(got) == len(set(root)) and len(set(root)) > 1


def test_lines_apart_are_no_pairs(spark, monkeypatch):
    """Lines of a bucket that all agree but belong to different components travel as lines, not as the square of them."""
    monkeypatch.setattr(lines, "BLOCK", 20)
    rows = spark.range(60).selectExpr("1L AS key", "id AS h", "0L AS sketch")
    found = lines.apart(rows, rows.selectExpr("h AS a", "h AS b").limit(0))
    blocks = 3
    assert 0 < found.count() <= 2 * 60 * blocks < 60 * 59 // 2


def test_lines_told_crosswise():
    """Similar pairs of groups that go over several frames, as by brute force."""
    draw = random.Random(3)
    stems = ["".join(draw.choices("abcdef", k=80)) for _ in range(3)]
    held = [(key, 0, 0, i, i % 5, 0, i % 2 == 0, stems[i % 3][: 60 + draw.randrange(20)] + draw.choice(["", "xyz"])) for key in range(3) for i in range(key * 30, key * 30 + 30)]
    frame = pd.DataFrame(held, columns=["key", "block", "turn", "h", "root", "sketch", "outside", "line"])
    got = pd.concat(list(lines.crosswise(frame.iloc[i : i + 7].reset_index(drop=True) for i in range(0, len(frame), 7))))
    due = []
    for one in held:
        for other in held:
            x, y = ({r[7][i : i + 5] for i in range(len(r[7]) - 4)} for r in (one, other))
            if one[0] == other[0] and one[6] and not other[6] and one[4] != other[4] and len(x & y) >= 0.8 * len(x | y):
                due.append((max(one[3], other[3]), min(one[3], other[3])))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(due) and due


def test_recall_of_bands_and_sketches():
    """Every pair of distinct lines whose shingle sets have a similarity of 0.8 or more, by brute force, against bands and sketches."""
    texts = duckdb.sql("SELECT lower(text) FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()
    held = sorted({line for (text,) in texts for raw in text.split("\n") if len(line := raw.strip(lines.BLANKS)) >= lines.SHINGLE})
    sets = [{line[i : i + lines.SHINGLE] for i in range(len(line) - lines.SHINGLE + 1)} for line in held]
    keys = lines.keys_of(held)
    places = lines.BANDS * lines.ROWS
    found = caught = 0
    for i, j in combinations(range(len(held)), 2):
        if 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            found += 1
            apart = int(keys[i, lines.BANDS]) ^ int(keys[j, lines.BANDS])
            odd = sum((apart >> (2 * k)) & 3 != 0 for k in range(places))
            caught += bool((keys[i, : lines.BANDS] == keys[j, : lines.BANDS]).any()) and places - odd >= lines.AGREE
    assert found > 20 and caught >= 0.95 * found


def test_lines_of_awkward_rows(awkward):
    assert lines.report(awkward).count() == len(TEXTS) and lines.dedup(awkward).columns == awkward.columns


def test_empty_tables(spark, awkward, items, labels):
    none = awkward.where("false")
    assert ngram_join.report(none).count() == katz.score(none).count() == winnow.against_edits(none).count() == 0
    assert sharding.shards(none).count() == lines.report(none).count() == quality.score(none, labels).count() == 0
    assert decontaminate.report(awkward, items.where("false")).where("n_hit > 0").count() == 0
    assert bpe.digest(none, queries.vocabulary_file()).count() == licenses.scan(none).count() == 0
    assert urls.judge(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), spark.createDataFrame([], "host string, bad int")).count() == 0


def test_pipeline_stages(spark, tmp_path, awkward, labels, items):
    import corpus_pipeline

    folder = str(tmp_path)
    awkward.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_of_no_documents(spark, tmp_path, awkward, labels, items):
    import corpus_pipeline

    folder, before = str(tmp_path), spark.conf.get(corpus_pipeline.BATCH)
    awkward.where("false").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0 and spark.conf.get(corpus_pipeline.BATCH) == before


def limits_of(module, spark, monkeypatch):
    """Rows a Python worker may hold at once in each table that the module writes, filled while it runs."""
    held, plain = [], module.written

    def watched(df, name):
        held.append(int(spark.conf.get(BATCH_CONF)))
        return plain(df, name)

    monkeypatch.setattr(module, "written", watched)
    return held


def test_join_workers_hold_few_rows(spark, awkward, monkeypatch):
    held, before = limits_of(ngram_join, spark, monkeypatch), spark.conf.get(BATCH_CONF)
    assert ngram_join.report(awkward).count() == awkward.count()
    assert held and max(held) <= ngram_join.BATCH_ROWS and spark.conf.get(BATCH_CONF) == before


def test_katz_workers_hold_one_block(spark, awkward, monkeypatch):
    held, before = limits_of(katz, spark, monkeypatch), spark.conf.get(BATCH_CONF)
    assert katz.score(awkward).count() == awkward.count()
    assert held and max(held) <= katz.BATCH_BLOCKS and spark.conf.get(BATCH_CONF) == before


def peak_mb(action):
    """The most memory that an action holds at once beyond what was there before, and its result."""
    tracemalloc.start()
    try:
        result = action()
        return tracemalloc.get_traced_memory()[1] / 2**20, result
    finally:
        tracemalloc.stop()


def test_katz_numbers_keys_like_unique():
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint64)):
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        assert all(np.array_equal(x, y) for x, y in zip(katz.numbered(keys), (first, number)))


def test_katz_block_memory():
    rng = np.random.default_rng(2)
    vocabulary = np.unique(rng.integers(1, 2**63, 50_000, dtype=np.uint64))
    local = np.minimum(rng.zipf(1.2, 1_000_000), len(vocabulary)) - 1
    row = types.SimpleNamespace(
        vocabulary=katz.pack_sorted(vocabulary), local=katz.pack(local.astype(np.uint64), 4), sizes=[1000] * 1000, held_out=[i % 5 == 1 for i in range(1000)]
    )
    answers = pd.DataFrame({"bucket": [0], "answer": [katz.pack(np.bincount(local, minlength=len(vocabulary)).astype(np.uint64))]})
    used, block = peak_mb(lambda: katz.Block(row, answers))
    assert used < 50  # 65 with np.unique
    pairs = np.stack([block.history, block.word])[:, block.bigram]
    assert (pairs[1] == local).all() and (pairs[0][::1000] == len(vocabulary)).all() and (pairs[0][1:1000] == local[:999]).all()


def test_quality_fit_memory():
    rng = np.random.default_rng(3)
    rows, marks = rng.poisson(0.5, (quality.SAMPLE, quality.TERMS + 2)).astype(np.float32), rng.integers(0, 2, quality.SAMPLE)
    used, space = peak_mb(lambda: quality.Space.fit(rows, marks, quality.DIMENSIONS))
    assert used < 150  # 188 with all rows widened at once
    weighed = quality.Space.weigh(rows, space.idf).astype(float)
    assert np.allclose(np.linalg.norm(weighed @ space.axes, axis=0) ** 2, np.linalg.eigvalsh(weighed.T @ weighed)[::-1][: quality.DIMENSIONS], rtol=1e-3)


def test_quality_fit_of_narrow_rows():
    rng = np.random.default_rng(4)
    rows, marks = rng.poisson(0.2, (quality.SAMPLE, quality.TERMS + 2)).astype(np.float32), rng.integers(0, 2, quality.SAMPLE)
    packed = [quality.narrow(row) for row in rows]
    assert np.array_equal(quality.widen(packed[:100]), rows[:100])
    used, space = peak_mb(lambda: quality.Space.fit(packed, marks, quality.DIMENSIONS))
    assert used < 80  # 134 with all rows widened beside the Gram matrix
    assert np.abs(quality.Space.fit(rows, marks, quality.DIMENSIONS).vectors - space.vectors).max() < 1e-5


def test_leading_directions(monkeypatch):
    rng = np.random.default_rng(5)
    for ranks in (300, 10, 0):  # many directions, fewer than asked, none
        axes = np.linalg.qr(rng.standard_normal((400, 300)))[0][:, :ranks]
        sizes = 0.9 ** np.arange(ranks)
        gram = (axes * sizes) @ axes.T
        found = quality.leading(gram, 32)
        k = min(32, ranks)
        assert found.shape == (400, 32) and np.allclose(found.T @ found, np.eye(32))
        assert np.allclose(found[:, :k] @ found[:, :k].T, axes[:, :k] @ axes[:, :k].T, atol=1e-7)
    monkeypatch.setattr(quality, "ROUNDS", 0)
    assert np.allclose(np.abs(quality.leading(np.diag(np.arange(400.0)), 2)).sum(), 2)


def test_katz_narrow_numbers():
    for values in (np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.array([255, 0], np.uint64), np.array([256, 1], np.uint64), np.array([2**64 - 1], np.uint64)):
        assert np.array_equal(np.broadcast_to(katz.unpack_narrow(katz.pack_narrow(values)), len(values)), values)
    assert len(katz.pack_narrow(np.arange(300, dtype=np.uint64))) == 601


def test_katz_bucket_memory():
    rng, rows, seen = np.random.default_rng(6), [], {}
    for block in range(20):
        pairs = np.unique(rng.integers(0, 1 << 36, 50_000, dtype=np.uint64) >> np.uint64(18) if block % 2 else rng.integers(0, 1 << 40, 50_000, dtype=np.uint64))
        histories, sizes = np.unique(pairs >> np.uint64(24), return_counts=True)
        each, counts = rng.integers(0, 4, len(pairs)).astype(np.uint64), rng.integers(1, 1000, len(pairs)).astype(np.uint64)
        rows.append((7, block, katz.pack_sorted(histories), katz.pack(sizes.astype(np.uint64)), katz.pack(pairs & np.uint64((1 << 24) - 1), 6), katz.pack_narrow(each), katz.pack_narrow(counts)))
        for pair, n in zip(pairs.tolist(), each.tolist()):
            seen[pair] = seen.get(pair, 0) + n
        last = pairs
    asked = pd.DataFrame(rows, columns=["bucket", "block", "histories", "sizes", "words", "seen", "counts"])
    model = katz.Words.of([5, 4, 3, 2, 1, 1, 100, 10_000])
    bigrams = sum(map(len, asked["words"])) // 6
    used, answers = peak_mb(lambda: katz.add_bigrams(asked, model))
    assert used * 2**20 < 75 * bigrams  # 97 bytes a bigram with two copies of all histories, words and counts
    n, packed = np.frombuffer(answers["answer"].iloc[-1], np.uint64, 2).tolist()
    assert n == len(last) and katz.unpack_narrow(answers["answer"].iloc[-1][16 : 16 + packed]).tolist() == [seen[p] for p in last.tolist()]
    assert answers["stats"].iloc[0][-1] == sum(seen.values()) and answers["stats"].iloc[1:].isna().all()
