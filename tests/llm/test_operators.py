import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from math import comb
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from motionlake.llm import bpe, classify, fingerprint, linededup, mixing, neardup, rules, shard, token_count, warc  # noqa: E402
from motionlake.llm.common import table  # noqa: E402
from motionlake.llm.components import components  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module", params=["cases", "sf"])
def both(request, spark, docs, sf_dir):
    return docs if request.param == "cases" else table(spark, sf_dir, "documents")


def split(text):
    return WORD.findall((text or "").encode())


# sharding


def test_shards_are_whole_gapless_and_even(both):
    out = shard.shard_by_size(both).collect()
    rows = cases.rows_of(both)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for i, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    mean, largest = sum(sizes.values()) / 24, max(groups.values())
    assert max(sizes.values()) <= 1.2 * mean + largest
    assert sorted(map(tuple, out)) == sorted(map(tuple, shard.shard_by_size(both).collect())) if None not in [r["doc_id"] for r in out] else True


def test_a_text_that_overfills_its_range_is_cut(spark):
    rows = [(i, "the same text again" if i % 3 else f"text {i}") for i in range(3000)]
    out = shard.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 6 and max(sizes) < 1.1 * min(sizes)


# quality rules


def plain_measures(text):
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    n_repeat = len(covered)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), n_repeat, len(w) < 50 or 100 * n_repeat > 50 * len(w)


def test_measures(spark, both, sf_dir):
    out = rules.quality_rules(both, table(spark, sf_dir, "labels")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[x] for x in names)) for r in out) == Counter((i, *plain_measures(t)) for i, t in cases.rows_of(both))
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((50, 0, 0.01), (200, 3, 0.02), (1000, 12, 0.02), (5000, 60, 0.015)):
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(F.exp(rules.log_binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p))).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_reject_junk_and_spare_good(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        w = [f"w{rng.randrange(5000)}" + ("###" if bad and rng.random() < 0.9 else "") for _ in range(80)]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    out = rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = Counter((r["doc_id"] % 10 == 0, r["kept"]) for r in out)
    assert kept[True, True] == 0 and kept[False, False] <= 0.02 * 5400
    few = rules.quality_rules(docs, spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in few)  # nothing is certified on few labels


def test_copies_of_a_text_are_one_trial(spark):
    """100 different good texts and 1,900 labelled copies of a clean one certify nothing."""
    rng = random.Random(2)
    clean = [cases.words(rng, 80) for _ in range(101)]
    rows = [(i, clean[min(i, 100)], "en") for i in range(2000)] + [(2000, "# " + cases.words(rng, 80).replace("w1", "w###"), "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    out = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert len(out) == 2001 and all(r["kept"] for r in out)


def test_small_strata_share_a_cutoff(spark):
    """1,500 good texts are enough for a pool of strata of which none has enough alone."""
    rng, langs = random.Random(4), ["de", "en", "es", "fr", None]
    rows = [(i, cases.words(rng, 80 if i % 3 else 210, 4000), langs[i % 5]) for i in range(1500)]
    rows += [(1500 + i, cases.words(rng, 80, 4000).replace("w", "##"), langs[i % 5]) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    out = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert all(r["kept"] == (r["doc_id"] < 1500) for r in out) and not any(r["base_failed"] for r in out)


def test_pools_of_strata():
    n = {"en/0": 900, "en/1": 60, "de/0": 30, "fr/2": 5}
    assert set(rules.pooled(n, 100).values()) == {"en/0"}  # too small together: they join the smallest pool
    assert set(rules.pooled(n, 1000).values()) == {"any"}
    got = rules.pooled(n | {"de/1": 50, "es/1": 99}, 100)
    assert got["en/0"] == "en/0" and got["de/1"] == got["es/1"] == got["en/1"] == "any/1" and set(got) == set(rules.STRATA)
    assert got["fr/2"] == got["de/0"] == "any/1"


# byte-level BPE


def test_bpe_equals_the_library(both):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(Path(path).read_bytes())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in cases.rows_of(both):
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(both, path).collect()) == want
    for r in bpe.encode_documents(both, path).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"]


def test_appends_and_edits_are_exact():
    coder = bpe.BpeCoder(bpe.load_ranks(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()))
    rng = random.Random(2)
    text = cases.words(rng, 400).encode() + "élément größer niño".encode() * 20
    again = 0
    for _ in range(150):
        s = rng.randrange(len(text) - 300)
        data = text[s : s + 250]
        t = bpe.PrefixTable(coder, data[:100])
        t.append(data[100:])
        assert t.last == bpe.PrefixTable(coder, data).last
        a = rng.randrange(200)
        b, new = a + rng.randrange(9), text[: rng.randrange(9)]
        again += t.edit(a, b, new)
        assert t.last == bpe.PrefixTable(coder, data[:a] + new + data[b:]).last and b"".join(coder.token[x] for x in t.ids()) == t.data
        assert t.ids(30) == bpe.PrefixTable(coder, t.data[:30]).ids()
    assert again < 150 * 100


def test_odd_characters_split_as_the_library():
    import tiktoken

    ranks = bpe.load_ranks(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, split_by, rng = bpe.BpeCoder(ranks), regex.compile(bpe.PATTERN), random.Random(4)
    odd = "abcdeéüñ漢 \t\n\r\x0b\x0c\x1c\x1f\x85 　's01٣½#*🙂́​﻿"
    for _ in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(25)))
        assert np.frombuffer(coder.encode(text, split_by), "<u4").tolist() == library.encode_ordinary(text)


# token counts


@pytest.mark.parametrize("hot", [100_000, 3])
def test_token_counts_equal_the_library(both, hot):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    want = Counter()
    for i, t in cases.rows_of(both):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert Counter(tuple(r) for r in token_count.count_tokens(both, path, hot=hot).collect()) == want


# fingerprints


@pytest.mark.parametrize("range_bytes", [4 << 20, 2000])
def test_edited_neighbours(both, range_bytes):
    rows = sorted(cases.rows_of(both), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = fingerprint.edited_neighbours(both, range_bytes=range_bytes).collect()
    assert len(out) == len(rows)
    prints = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    by_text = defaultdict(set)
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out)
    ids = Counter(i for i, _ in rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)]
        for p in prints[i, len(t)] if ids[i] == 1 else ():
            by_text[t].add(p)
        if ids[i] == 1 and ids[following[0]] == 1:
            cut = len(t) // 2
            edited = t[: len(t) - cut] + (following[1] or "")[:cut]
            assert got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] == 1
    assert all(len(p) == 1 for p in by_text.values()) and len({next(iter(p)) for p in by_text.values()}) == len(by_text)


def test_span_equality_and_extensions():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert x.spans_equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        ahead = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        behind = next((k for k in range(min(i, j)) if a[i - 1 - k] != b[j - 1 - k]), min(i, j))
        assert (x.extension(i, y, j), x.extension_back(i, y, j)) == (ahead, behind)
    assert fingerprint.PrefixHash("").likeness(fingerprint.PrefixHash("")) == 1


def test_joined_hashes_equal_those_of_the_joined_text():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé🙂") for _ in range(rng.choice([0, 1, 5, 23, 24, 25, 47, 60, 200]))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        made, plain = fingerprint.PrefixHash.joined(fingerprint.PrefixHash(a), i, fingerprint.PrefixHash(b), j), fingerprint.PrefixHash(a[:i] + b[:j])
        assert made.n == plain.n and made.digest() == plain.digest() and all((x == y).all() for x, y in zip(made.sums, plain.sums, strict=True))
        assert made.windows().tolist() == plain.windows().tolist()


def test_likeness_equals_a_plain_count():
    """Against a count over the texts themselves: common front and back, and windows found anywhere in the other text."""
    rng, w = random.Random(8), fingerprint.WINDOW

    def plain(a, b):
        if a == b:
            return 1.0
        short, long = min(len(a), len(b)), max(len(a), len(b))
        front = next((k for k in range(short) if a[k] != b[k]), short)
        back = min(next((k for k in range(short) if a[-1 - k] != b[-1 - k]), short), short - front)

        def covered(x, y):
            known, marks = {y[k : k + w] for k in range(len(y) - w + 1)}, [False] * len(x)
            marks[:front] = [True] * front
            marks[len(x) - back :] = [True] * back
            for k in range(len(x) - w + 1):
                if x[k : k + w] in known:
                    marks[k : k + w] = [True] * w
            return sum(marks)

        return min(covered(a, b), covered(b, a), long - 1) / long

    base = "".join(rng.choice("abcd") for _ in range(400))
    for _ in range(200):
        x, y = rng.randrange(400), rng.randrange(400)
        a = base[:x] + rng.choice(["", "x", "other"]) + base[x : rng.randrange(x, 401)]
        b = rng.choice([base[y:] + base[:y], base[:y] + "y" + base[y:], a, "", base[y : y + 30] * 3])
        assert fingerprint.PrefixHash(a).likeness(fingerprint.PrefixHash(b)) == pytest.approx(plain(a, b))


def test_likeness_counts_agreement_between_and_out_of_place():
    rng = random.Random(6)
    like = lambda a, b: fingerprint.PrefixHash(a).likeness(fingerprint.PrefixHash(b))
    body, moved = cases.words(rng, 300, 10**6), cases.words(rng, 300, 10**6)
    assert like("one head\n" + body + "\na foot", "another first line\n" + body + "\nits own footer") > 0.9
    assert like(body + moved, moved + body) > 0.9 and like(body, moved) < 0.1
    w = body.split(" ")
    for k in (40, 150, 260):
        w[k] = "changed"
    assert like(body, " ".join(w)) > 0.9
    assert like(body, body * 5) <= 0.2 and like(body, body) == 1 == like("", "")
    for a, b in ((body, body[1:]), ("", "a"), ("ab" * 40, "ba" * 40), ("short", "shirt")):
        assert like(a, b) == like(b, a) < 1
    for n in (0, 1, 23, 24, 25, 60):  # against plain windows
        a = "".join(rng.choice("ab") for _ in range(n))
        b = "x" + a[5:] + "y" + a[:30]
        x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        held = {i + k for i in range(n - 23) if a[i : i + 24] in b for k in range(24)}
        assert x.agreeing(y, 0, 0) == len(held)


# classifier


def test_classifier_learns_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1" if Path("/root/testdata/sf0.1").exists() else None
    if not sf:
        pytest.skip("needs the larger labels")
    labels = table(spark, sf, "labels")
    out = classify.classify(table(spark, sf, "documents"), labels)
    rows = out.where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.8
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())


def test_scores_of_odd_texts(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    out = classify.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in cases.rows_of(docs))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    one = classify.classify(docs, labels.where("quality = 1")).collect()  # one class only
    assert all(0 <= r["score"] <= 1 for r in one)


def test_qda_equals_dense_gaussians():
    rng = np.random.default_rng(1)
    x = {c: rng.normal(c, 1 + c, (300, 3)) for c in (0, 1)}
    model = classify.Qda({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, pooled=0.0, identity=0.0)
    z = rng.normal(0.5, 1, (20, 3))

    def density(c):
        v = np.cov(x[c].T, bias=True)
        d = z - x[c].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(v), d) - 0.5 * np.log(np.linalg.det(v)) + np.log(len(x[c]))

    assert np.allclose(model.score(z), 1 / (1 + np.exp(density(0) - density(1))))


# mixing


def plain_targets(sizes, weights):
    total, t, capped = 1.5 * sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(2.0 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        w = sum(weights[i] for i in free)
        for i in free:
            t[i] = left * weights[i] / w
        over = {i for i in free if t[i] > 2.0 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in capped else t[i] for i in range(len(sizes))]
        capped |= over


def test_mix_meets_targets(spark, both):
    out = mixing.mix(both).collect()
    rows = both.select("doc_id", "text", "source").collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r["doc_id"], len(split(r["text"]))) for r in rows)
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(split(r["text"])) for r in rows if r["source"] == s) for s in names]
    want = plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, size, target in zip(names, sizes, want, strict=True):
        got = next(r for r in out if r["source"] == s)
        assert got["source_size"] == size and got["target"] == pytest.approx(target)
        assert abs(taken[s] - target) <= largest[s]
    again = mixing.mix(both).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_reduction_tree_over_levels(spark):
    rows = spark.createDataFrame([("a", 500, i, 1, 1 + i % 17, 0.37) for i in range(500)], "source string, n_rows long, doc_id long, dup int, size long, p double")
    out = mixing.pivotal(rows, 500, block=4).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(500))
    mass = sum(r["copied"] * (1 + r["doc_id"] % 17) for r in out)
    assert abs(mass - 0.37 * sum(1 + i % 17 for i in range(500))) <= 17


def test_mixed_documents_are_the_copies(both):
    counts = Counter()
    for r in mixing.mix(both).collect():
        counts[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(both).collect()) == Counter({k: v for k, v in counts.items() if v})


# WARC


def page_table(spark):
    rng = random.Random(6)
    long = [cases.words(rng, 300) for _ in range(4)]
    rows = [(i * 2 - 5, f"http://h/{i} x", long[i % 4] if i % 3 else f"page {i} é\r\n\r\nWARC/1.0") for i in range(40)]
    rows += [(None, None, long[0]), (7_000_000_000_000, "http://x", None), (-9, "", ""), rows[1], (rows[1][0], "http://other", long[2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, sf_dir):
    for pages in (page_table(spark), table(spark, sf_dir, "pages")):
        rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.select("page_id", "html").collect()]
        top = {}
        for i, b in rows:
            if len(b) >= 1000 and i is not None:
                top[b] = max(top.get(b, i), i)
        want = Counter()
        for i, b in rows:
            t = top.get(b) if i is not None and top.get(b) != i else None
            want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if t is not None else "response", t] += 1
        got = Counter(tuple(r) for r in warc.archive_pages(pages).collect())
        assert got == want


def test_arc_versions_and_faults():
    v1 = b"filedesc://a 0.0.0.0 20010101000000 text/plain 9\n1 0 drivr\n\nhttp://a b/ 1.2.3.4 20010102030405 text/html 5\nhello\n"
    (r,) = warc.parse_arc(v1)
    assert r["url"] == "http://a b/" and r["body"] == b"hello" and r["version"] == 1
    made = warc.warc_record(r, -3, None)
    ((h, block),) = warc.read_warc(made + b"\r\n\r\n")
    assert h["warc-type"] == "resource" and block == b"hello" and h["warc-date"] == "2001-01-02T03:04:05Z" and h["warc-ip-address"] == "1.2.3.4" and warc.key_of(h["warc-record-id"]) == -3
    v2 = b"filedesc://a 0.0.0.0 20010101000000 text/plain 200 - - 0 f 9\n2 0 drivr\n\nhttp://a/ 1.2.3.4 20010102030405 text/html 200 - - 7 f 5\nhello\n"
    (r,) = warc.parse_arc(v2)
    assert r["result_code"] == "200" and r["offset"] == "7" and r["body"] == b"hello"
    for broken in (v1[:-4], v1.replace(b"text/html 5", b"text/html 500"), v1.replace(b"1 0 drivr", b"7 0 drivr"), b"no newline"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))
    assert warc.key_of(f"<urn:uuid:{warc.record_uuid(None, b'12345678')}>") is None


# near duplicates and components


def plain_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((60, 40), (200, 230), (50, 49)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n > 50 else [(i, i + 1) for i in range(49)]
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        want = plain_components(range(n), pairs)
        assert all(got.get(k, k) == v for k, v in want.items())


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near(rows, percent):
    """Component by position."""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    shared = Counter()
    for ks in at.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[ks[b], ks[a]] += 1
    return sets, plain_components(range(len(rows)), [p for p, n in shared.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)])


@pytest.mark.parametrize("leaf", [64, 3])
def test_near_duplicates_equal_brute_force(both, leaf):
    rows = cases.rows_of(both)
    sets, comp = plain_near(rows, 85)
    groups = defaultdict(list)
    for k, c in comp.items():
        groups[c].append(k)
    want = Counter()
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            name = min(ids) if ids else None
            want[rows[k][0], len(sets[k]), name, rows[k][0] == name] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(both, leaf=leaf).collect())
    assert got == want


def test_large_groups_of_near_copies(spark):
    """A chain of variants and a tight group, each beyond the leaf size at every level."""
    rng = random.Random(9)
    base, rows = [f"t{rng.randrange(10**6)}" for _ in range(300)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    w = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(60):
        w = list(w)
        for k in range(3):
            w[(i * 5 + k) % 300] = f"d{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    _, comp = plain_near(rows, 85)
    want = {rows[k][0]: rows[c][0] for k, c in comp.items()}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def unlike(n, common=70, own=30, seed=3):
    """Documents that share most of their words, and no pair of them at the threshold."""
    rng = random.Random(seed)
    head = [f"h{rng.randrange(10**6)}" for _ in range(common * 3)]
    return [(i, " ".join(head + [f"o{rng.randrange(10**9)}" for _ in range(own * 3)])) for i in range(n)]


def test_unlike_documents_of_one_node_meet_seldom(spark, monkeypatch):
    met = []
    compared = neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda places, *a: met.append(places.count()) or compared(places, *a))
    for n in (300, 600):
        met.append(0)
        out = neardup.near_duplicates(spark.createDataFrame(unlike(n), "doc_id long, text string"), leaf=16).collect()
        assert len(out) == n and all(r["kept"] for r in out)
    small, large = sum(met[: met.index(0, 1)]), sum(met[met.index(0, 1) :])
    assert 0 < large <= 3 * small


def template_pages(n, seed=6):
    """Pages of one template, the rest of each from a pool of 40 phrases: none at the threshold, all with much in common."""
    rng = random.Random(seed)
    head = [f"h{i}" for i in range(330)]
    pool = [[f"p{k}x{i}" for i in range(22)] for k in range(40)]
    return [(i, " ".join(head + [w for k in rng.sample(range(40), 10) for w in pool[k]])) for i in range(n)]


def test_pages_of_one_template_give_few_rows(spark, monkeypatch):
    """Pages that are no near copies give fewer likely rows and stars than there are pages, of up to 319,600 pairs."""
    sums, likely, stars = [], neardup._likely, neardup._stars
    found = []

    def counting(*args):
        out = likely(*args)
        found.append(out.count())
        return out

    def counted(*args):
        out = stars(*args)
        found.append(out.count() if out is not None else 0)
        return out

    monkeypatch.setattr(neardup, "_likely", counting)
    monkeypatch.setattr(neardup, "_stars", counted)
    for n in (200, 400, 800):
        found.clear()
        rows = template_pages(n)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        _, comp = plain_near(rows, 85) if n == 200 else (None, None)
        assert comp is None or got == {rows[k][0]: rows[c][0] for k, c in comp.items()}
        sums.append(sum(found))
    assert sums[0] <= 200 and sums[1] <= 400 and sums[2] <= 2 * 800


def test_bits_of_near_sets_are_near():
    rng = np.random.default_rng(5)
    for size, percent in ((20, 85), (40, 80), (300, 85), (5000, 80)):
        both = math.ceil(2 * size * percent / (100 + percent))
        for _ in range(200 if size < 5000 else 10):
            u = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64)
            a, b, c = np.sort(u[:size]), np.sort(u[size - both :]), np.sort(rng.integers(0, 2**63, size).astype(np.uint64))
            bits = [neardup.set_bits(x).view(np.uint64) for x in (a, b, c)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= neardup.most_differing(percent) < np.bitwise_count(bits[0] ^ bits[2]).sum()


def test_residual_pairs_of_a_giant_node_are_found(spark):
    """Among many unlike documents of one node, planted pairs at and just below the threshold, by the exact pass alone."""
    rng = random.Random(4)
    rows = unlike(200)
    for i in range(0, 40, 2):  # at most 5 shingles go with each changed word
        w = rows[i][1].split(" ")
        for k in rng.sample(range(5, len(w) - 5), 2 + i // 8):
            w[k] = f"z{rng.randrange(10**9)}"
        rows[i + 1] = (i + 1, " ".join(w))
    _, comp = plain_near(rows, 85)
    assert 5 < sum(k != c for k, c in comp.items()) < 20
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), trees=4, depth=1, leaf=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {rows[k][0]: rows[c][0] for k, c in comp.items()}


def test_one_of_each_with_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, text + " end"), (1, text), (None, text.upper()), (None, text + " other"), (7, text), (8, None), (9, " "), (9, " "), (None, "alone"), (None, "alone")]
    left = cases.rows_of(neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len([x for x in left if x[1] and x[1].startswith("w")]) == 1
    assert Counter(left)[(None, "alone")] == 1 and Counter(left)[(9, " ")] == 2 and (8, None) in left


def test_one_of_each_group_stays(both):
    rows = cases.rows_of(both)
    _, comp = plain_near(rows, 80)
    kept = neardup.one_of_each(both, percent=80)
    assert kept.columns == both.columns
    left = cases.rows_of(kept)
    ids = Counter(i for i, _ in rows)
    sure = [k for k in comp if ids[rows[k][0]] == 1 and rows[k][0] is not None]
    stay = {i for i, _ in left}
    groups = defaultdict(list)
    for k in sure:
        groups[comp[k]].append(rows[k][0])
    for c, members in groups.items():
        if len(members) == sum(v == c for v in comp.values()):
            assert [m for m in members if m in stay] == [min(members)]


def test_mix_with_clashing_columns_and_rows_of_one_id(spark):
    rows = [(i % 3 if i % 5 else None, f"text number {i // 2} of one source", "s", i, "c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {(r["doc_id"], r["dup"]): r["copies"] for r in mixing.mix(docs).collect()}
    assert len(taken) == 60 and sum(taken.values()) == out.count() > 60


# line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, text, edits, letters):
    b = list(text)
    for _ in range(edits):
        p = rng.randrange(len(b) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            b.insert(p, rng.choice(letters))
        elif b:
            p = min(p, len(b) - 1)
            if kind == 1:
                b.pop(p)
            else:
                b[p] = rng.choice(letters)
    return "".join(b)


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(6000):
        t = rng.randrange(5)
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = mutate(rng, a, rng.randrange(6), "abc")
        assert linededup.within(a, b, t) == (distance(a, b) <= t)


def test_probes_meet_every_pair_within_the_threshold():
    rng = random.Random(3)
    for _ in range(4000):
        t = rng.randrange(1, 4)
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(t + 1, 16)))
        b = mutate(rng, a, rng.randrange(t + 1), "ab")
        if len(b) > t:
            short, long = sorted((a, b), key=len)
            index = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(linededup.segments(len(short), t))}
            assert any((n, i, long[p : p + z]) in index for n, i, p, z in linededup.probes(len(long), t))


def plain_dropped(spark, rows, threshold, per_edit):
    """Dropped positions per (doc_id, text): equal lines after the first, and lines near one that stays and comes before them."""
    ranked = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    digest = {(r["doc_id"], r["text"]): (r["digest"], r["rank"]) for r in ranked.withColumn("rank", F.xxhash64("doc_id", "digest")).collect()}
    spots = sorted((i, digest[i, t][0], p, line, digest[i, t][1], t) for i, t in rows for p, line in enumerate((t or "").split("\n")) if split(line))
    first = {}
    for spot in spots:
        first.setdefault(spot[3], spot)
    near = lambda a, b: abs(len(a) - len(b)) <= threshold and distance(a, b) <= min(threshold, min(len(a), len(b)) // per_edit)
    stay = []
    for line in sorted(first, key=lambda x: (first[x][4], hashlib.md5(x.encode()).digest())):
        if not any(near(line, x) for x in stay):
            stay.append(line)
    kept, want, n_near = set(stay), defaultdict(set), Counter()
    for i, d, p, line, _, t in spots:
        if line not in kept or first[line][:3] != (i, d, p):
            n_near[i, t] += line not in kept and p not in want[i, t]
            want[i, t].add(p)
    return want, n_near


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    base = [cases.words(rng, rng.randrange(3, 9)) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3]), "abw1 ") for _ in range(rng.randrange(1, 6))] + rng.choice([[], [""], ["short", "shor"]])
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, rows[0][1])]
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n_chars long, pos string").repartition(4)
    want, n_near = plain_dropped(spark, rows, 2, 20)
    assert sum(n_near.values()) > 10
    for limit, heavy in ((linededup.BROADCAST_IDS, 64), (-1, 1)):  # both ways to fetch the candidates; heavy keys
        monkeypatch.setattr(linededup, "BROADCAST_IDS", limit)
        monkeypatch.setattr(linededup, "BROADCAST_CUTS", limit)
        monkeypatch.setattr(linededup, "HEAVY", heavy)
        got = {r["doc_id"]: r for r in linededup.line_dedup(docs).collect()}
        assert {i: r["dropped"] for i, r in got.items()} == {i: sorted(want[i, t]) for i, t in rows}
        assert all(got[i]["n_near"] == n_near[i, t] for i, t in rows)
    assert all(r["n_kept"] == r["n_lines"] - len(r["dropped"]) for r in got.values())
    texts = {r["doc_id"]: r for r in linededup.deduped(docs).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i, t])
        if want[i, t] and not split(left):
            assert i not in texts
        else:
            assert texts[i]["text"] == left and texts[i]["n_chars"] == (len(left) if want[i, t] else 3)


def test_lines_along_a_chain_are_not_lost(spark):
    """A thousand numbered lines: what goes is within two edits of what stays, and what stays is not within two edits of each other."""
    lines = [f"Your invoice number {i:05d} is ready to be paid at the desk" for i in range(1000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, 1000, 10)], "doc_id long, text string")
    rows = {r["doc_id"]: set(r["dropped"]) for r in linededup.line_dedup(docs).collect()}
    stay = [line for i in range(0, 1000, 10) for p, line in enumerate(lines[i : i + 10]) if p not in rows[i]]
    assert len(stay) >= 10  # three digits that all differ
    assert all(linededup.within(line, x, 2) == (line == x) for line in stay for x in stay)
    assert all(any(linededup.within(line, x, 2) for x in stay) for line in lines)


@pytest.mark.parametrize(("share", "front"), [(0.33, 1.0), (0.8, 1.0), (0.8, 0.5), (0.95, 0.7)])
def test_lines_with_much_in_common_meet_seldom(spark, monkeypatch, share, front):
    """Lines of one length that share a part, with some pairs at two edits among them: what meets grows with the lines."""
    met, plain = [], linededup._met

    def counting(index, probe, heavy, threshold):
        met.append(index.join(heavy, "key", "left_anti").join(probe.select("key"), "key").count())
        return plain(index, probe, heavy, threshold)

    monkeypatch.setattr(linededup, "_met", counting)
    monkeypatch.setattr(linededup, "HEAVY", 32)  # keys of fewer lines meet as they are
    sums = []
    for n in (1000, 2000):
        rng = random.Random(5)
        common = "".join(rng.choice("klmnopqr ") for _ in range(int(300 * share)))
        at = int(len(common) * front)
        lines = [common[:at] + "".join(rng.choice("abcdefgh ") for _ in range(300 - len(common))) + common[at:] for _ in range(n)]
        for i in range(0, 20, 2):
            lines[i + 1] = "x" + lines[i][1:80] + "yz"[i % 4 // 2] + lines[i][81:]
        met.clear()
        pairs = linededup.candidates(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string"), 2, 20)
        assert pairs.count() >= 10
        sums.append(sum(met))
    assert sums[1] <= 2.5 * sums[0] + 1000 and sums[1] <= 60 * 2000


def test_cuts_fall_where_lines_differ():
    rng = random.Random(1)
    lines = ["same" * 20 + "".join(rng.choice("abcdefgh") for _ in range(9)) + "same" * 5 for _ in range(60)]
    first, second = linededup.cuts(lines, 2)
    assert 81 <= first < second <= 88
    assert linededup.cuts(["x" * 30] * 5, 2) == [10, 20]
    assert all(0 < a < b < 20 for a, b in [linededup.cuts(["y" * 19 + c for c in "abc"], 2), linededup.cuts([c + "y" * 19 for c in "abc"], 2)])


#: Every name that the stages give to columns of their own, and some that they gave once.
OWN_NAMES = """_doc _digest _dropped _own _dup _copy _text _same _copies _kept _rule_lines _rule_n_words _stratum _number _times _doc2 _digest2 _mark _key _source
    row mark same copies copy dup digest head head_digest own own_digest times left dropped gone_doc gone_digest taken taken_doc taken_dup size key id line lines
    label sid leaf side node tree path paths n near first rank word stratum kept count source_size target ratio item items held done token pos"""


@pytest.mark.parametrize("stage", ["keep_good", "deduped", "one_of_each", "mixed_documents"])
def test_columns_with_any_name_pass_through(spark, stage):
    rng = random.Random(4)
    names = OWN_NAMES.split()
    texts = ["\n".join(cases.words(rng, 70) for _ in range(3)) for _ in range(6)]
    texts += [texts[0] + "\nand one more line that stands in no other", texts[1], texts[2].replace("w1 ", "w2 ", 1)]
    rows = [(i, t, "en", "s1" if i % 2 else None, len(t), *(f"{c} of {i}" for c in names)) for i, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    run = {"keep_good": lambda: rules.keep_good(docs, labels), "deduped": lambda: linededup.deduped(docs), "one_of_each": lambda: neardup.one_of_each(docs), "mixed_documents": lambda: mixing.mixed_documents(docs)}[stage]
    out = run()
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) >= 6
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in found for c in names)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs = narrow
    assert Counter(tuple(r)[:5] for r in found) == Counter(map(tuple, run().collect()))


def test_line_dedup_of_odd_texts(both):
    rows = linededup.line_dedup(both).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in cases.rows_of(both))
    out = linededup.deduped(both)
    assert out.columns == both.columns and out.count() <= len(rows)


# empty tables


def test_empty_tables(spark):
    none, labels = cases.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        linededup.line_dedup(none), linededup.deduped(none), shard.shard_by_size(none), rules.quality_rules(none, labels), rules.keep_good(none, labels),
        bpe.encode_digests(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), token_count.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")),
        fingerprint.edited_neighbours(none), classify.classify(none, labels), mixing.mix(none), mixing.mixed_documents(none), warc.archive_pages(pages),
        neardup.near_duplicates(none), neardup.one_of_each(none),
    ):
        assert out.collect() == []
