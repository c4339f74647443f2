"""Operators on text corpora against brute force, on small inputs with nulls, ties, repeats, empty and long texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import common, components, exact_dedup, fuzzy_lines, language, licenses, maxscore, minhash, mixing, packing, suffixes, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(common.UPPER, common.LOWER)
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wo xi yo zu".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def docs(spark, texts, ids=None, sources=None, langs=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- exact copies -------------------------------------------------------------------------------
@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates(spark, weak, keep):
    texts = ["Abc", "aBC", "abd", None, "", "ÄB", "äb", "x" * 50_000, "X" * 50_000, "abc"]
    hashes = (lambda t: [F.length(t), F.lit(0).cast("long")]) if weak else exact_dedup.content_hash  # a weak hash makes every collision happen
    got = by_id(exact_dedup.exact_duplicates(docs(spark, texts).withColumn("h1", F.lit(1)).withColumn("kept", F.lit("x")), keep=keep, hashes=hashes))
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(i)
    for t, ids in groups.items():
        for i in ids:
            best = (min if keep == "min" else max)(ids)
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(ids), i == best)
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_duplicates_kept_rows_nulls_and_repeats(spark):
    df = docs(spark, ["a", "A", "a", "b", "b", None], ids=[3, None, 5, 7, 7, None]).withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()) == [(-1, ""), (3, "a"), (7, "b"), (7, "b")]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in order}
        capped |= {s: 2 * sizes[s] for s in over}


def test_mixture_against_brute_force(spark):
    rng = random.Random(3)
    sources = [rng.choice(["b", "a", "a", "a", None, "Z", "é", ""]) for _ in range(600)]
    texts = [None if k % 50 == 0 else " \x0b".join(words(rng, rng.randint(0, 40))) for k in range(600)]
    df = docs(spark, texts, sources=sources).withColumn("size", F.lit("clash"))
    rows = mixing.mixture(df, block_rows=37).collect()
    assert len(rows) == 600
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, sizes, strict=True):
        total[s] += n
    want, key = brute_targets(total), lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest()
    queue, upto = [], Counter()
    for i in sorted(range(600), key=key):
        upto[sources[i]] += sizes[i]
        if sizes[i]:
            queue += [((c * total[sources[i]] + upto[sources[i]]) / want[sources[i]], sources[i] is not None, (sources[i] or "").encode(), key(i), i) for c in (0, 1)]
    run, taken = 0, Counter()
    for *_, i in sorted(queue):
        run += sizes[i]
        if run > sum(want.values()) + 0.5:
            break
        taken[i] += sizes[i]
    for r in rows:
        assert (r.size, r.source_size, r.taken) == (sizes[r.doc_id], total[r.source], taken[r.doc_id])
        assert r.target == pytest.approx(want[r.source])
    copies = Counter(r.doc_id for r in mixing.mix(df, block_rows=37).select(*df.columns).collect())
    assert copies == Counter({i: t // sizes[i] for i, t in taken.items()})


def test_mixture_edges(spark):
    assert mixing.mixture(docs(spark, []).limit(0)).count() == 0
    assert [r.taken for r in mixing.mixture(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    same = docs(spark, ["a b c"] * 4, ids=[1, 1, None, None], sources=["s", "s", None, None])
    assert sum(r.taken for r in mixing.mixture(same).collect()) == 18


# ---- packing ------------------------------------------------------------------------------------
def test_packing_round_trip(spark):
    rng = random.Random(5)
    odd = ["Ünïcödé İstanbul ΣΑΣ ﬁ ① x'll don't 12ab <|endoftext|> a<|startoftext|>b \x1c \x85 é. a.b.,;: 漢字。", "", None, "a..", " x　y"]
    texts = [" ".join(words(rng, rng.randint(0, 300))).capitalize() + "." for _ in range(120)] + odd + [" ".join(words(rng, 9000))]
    df = docs(spark, texts, ids=[k // 2 * 2 if k < 10 else k for k in range(len(texts))]).withColumn("offset", F.lit("x"))
    rows = packing.pack(df.coalesce(2), packing.tokenizer_path(), block_tokens=20_000, with_ids=True).collect()
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in zip([r.doc_id for r in df.collect()], texts, strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.update((i, len(ids), k, x) for k, x in enumerate(ids))
    assert want == Counter((r.doc_id, r.doc_tokens, r.start + k, x) for r in rows for k, x in enumerate(r.ids))
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0  # so nothing is padded
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0


def test_assignment_prefers_the_cheapest_sequence_and_cuts_only_if_it_must():
    out = packing.assign([4096, 2000, 2000, 96, 5000], 4096)
    assert sum(n for _, _, n, _, _ in out) == 13192 and {k for *_, k, _ in out} == set(range(len(packing.capacities(13192))))
    full = packing.assign([2048] * 4, 4096)
    assert sorted(k for *_, k, _ in full) == [0, 0, 1, 1]


# ---- near copies --------------------------------------------------------------------------------
def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").translate(LOWER)
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def union(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_texts(rng):
    texts = []
    for size in (30, 60, 120, 300):
        base = words(rng, size)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            texts.append(" ".join(w) if rng.random() < 0.8 else "\t".join(w).upper())
    chain = words(rng, 100)
    for k in range(8):  # neighbours are near, ends are not
        texts.append(" ".join(chain[3 * k :] + words(rng, 3 * k)))
    return [*texts, None, "", " ", "one two", "ONE two", "a b c d e", *[" ".join(words(rng, 50)) for _ in range(40)]]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    texts = near_texts(random.Random(11))
    got = by_id(minhash.near_duplicates(docs(spark, texts).withColumn("key", F.lit(1)).withColumn("n", F.lit("x")), percent=percent))
    sets = brute_sets(texts)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(len(texts), links)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), want[i], want[i] == i)


def test_star_rounds_reach_every_component(spark, monkeypatch):
    from barloom.llm import stars
    monkeypatch.setattr(stars, "CENTRES", 2)
    rows = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 50)], "key long, id long")
    kinds = spark.createDataFrame([(i, i % 7) for i in range(60)], "id long, kind int")
    links = stars.star_links(rows, kinds, "kind + other_kind >= 0", lambda ids: None, lambda pairs, _: pairs.filter("a % 7 = b % 7"))
    comps = by_id(components.components(links), "id")
    assert {i: r.comp for i, r in comps.items()} == {i: i % 7 for i in range(40)}


def test_near_duplicates_repeated_and_null_ids(spark):
    a, b = "u v w x y z", "p q r s t o"
    got = minhash.near_duplicates(docs(spark, [a, b, a, b, a], ids=[1, 1, 2, 3, None])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)], key=str)
    df = docs(spark, [a, a, None], ids=[5, 4, None]).withColumn("row", F.lit(0))
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["4", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    signer, hits = minhash.Signer(40, 8), []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        a, b = np.sort(pool[:48]), np.sort(pool[12:])  # 36 of 60 shared
        hits.append((signer.signature(a) == signer.signature(b)).mean())
    assert abs(np.mean(hits) - 0.6) < 0.06


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5)]
    got = by_id(components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")), "id")
    assert all(got[k].comp == 100 for k in range(100, 161)) and all(got[k].comp == 7 for k in range(300, 340)) and 5 not in got


# ---- repeated substrings ------------------------------------------------------------------------
def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "RANGE", 20)
    rng = random.Random(2)
    passages = [" ".join(words(rng, 30)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(words(rng, rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts += [p[a:b], " ".join(words(rng, rng.randint(0, 10)))]
        texts.append("".join(parts))
    texts += [None, "", "a" * 300, "ab" * 90, "a" * 70, texts[3], texts[3] + "é", "äöü" * 40]
    got = by_id(suffixes.remove_repeats(docs(spark, texts).withColumn("key", F.lit("x")), length=40, gram=16, hot=hot))
    for i, want in enumerate(brute_repeats(texts, 40)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want, i


def test_repeated_rows_are_occurrences(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=500))
    got = suffixes.remove_repeats(docs(spark, [text, text, "x" + text[:380]], ids=[1, 1, None])).collect()
    assert sorted((r.n_removed, r.n_spans) for r in got) == [(0, 0), (500, 1), (500, 1)]
    assert suffixes.remove_repeats(docs(spark, []).limit(0)).count() == 0


def test_loser_tree_merges_and_counts_shared_prefixes():
    rng = random.Random(4)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [([suffixes.shared_prefix(r[k - 1] if k else b"", s, 0) for k, s in enumerate(r)], r) for r in runs]
    out = [(runs[r][n], k) for r, n, k in suffixes.LoserTree(coded)]
    assert [s for s, _ in out] == sorted(s for r in runs for s in r)
    before = b""
    for s, k in out:
        assert k == suffixes.shared_prefix(before, s, 0)
        before = s


# ---- fuzzy lines --------------------------------------------------------------------------------
def normalise(line):
    return re.sub(r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line.translate(LOWER)).strip(" ")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines_stay_once(spark):
    rng = random.Random(8)
    base = [" ".join(words(rng, n)) for n in (3, 12, 60, 90)]
    near = base[3].replace(" ", ", ", 3)[:-1] + "q"
    texts = [f"{base[0]}\n{base[2]}\n\n{base[3]}", f"{base[2].upper()}!\n{near}\n{base[1]}", None, "", f"...\n{base[0]}\n\n{base[1]} extra", f"{base[1]}\n{base[1]}"]
    lines = [(d, k, normalise(x)) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    got = {(r.doc, r.line): r.stays for r in fuzzy_lines.line_decisions(docs(spark, texts).withColumn("line", F.lit("x"))).collect()}
    assert set(got) == {(d, k) for d, k, _ in lines}
    kept = [n for d, k, n in lines if n and got[(d, k)]]
    assert all(got[(d, k)] for d, k, n in lines if not n)
    for d, k, n in lines:
        if n and not got[(d, k)]:  # what goes is like a line that stays
            assert min(edit_distance(n, x) / max(len(n), len(x)) for x in kept) <= 0.1
    assert len(kept) == len(set(kept)) and sum(not s for s in got.values()) == 5
    out = by_id(fuzzy_lines.dedup_lines(docs(spark, texts)))
    assert out[2].text is None and out[3].text == "" and out[1].text == base[1] and out[5].text == ""
    assert fuzzy_lines.line_decisions(docs(spark, []).limit(0)).count() == 0


def test_fuzzy_lines_against_all_pairs(spark):
    """Lines of 3 to 60 words with changed words and typos: what is like another line goes, and nothing else does."""
    rng, lines = random.Random(11), []
    for n in [*range(3, 61)] * 2:
        line = " ".join(words(rng, n))
        changed = line.split()
        changed[rng.randrange(n)] = words(rng, 1)[0]
        typo = list(line)
        for _ in range(rng.randint(1, max(1, len(line) // 12))):
            typo[rng.randrange(len(typo))] = rng.choice("abcdefgh")
        lines += [line, " ".join(changed), "".join(typo)]
    norm = [normalise(x) for x in lines]
    got = {r.doc: r.stays for r in fuzzy_lines.line_decisions(docs(spark, lines), min_words=3).collect()}
    near = [(a, b) for b in range(len(norm)) for a in range(b - b % 3, b) if edit_distance(norm[a], norm[b]) <= int(0.1 * max(len(norm[a]), len(norm[b])))]
    root = union(len(norm), near)
    want = {k: all(root[j] != root[k] for j in range(k)) for k in range(len(norm))}
    assert len(near) > 150 and got == want


def test_lines_that_share_only_a_phrase_do_not_meet(spark):
    """A bucket is cut where lengths or places of the common run can't be those of near lines; repeated runs keep all places."""
    rng, phrase = random.Random(5), "a phrase of many lines"
    line = " ".join(words(rng, 40))
    texts = [phrase + " " + line, " ".join(words(rng, 40)) + " " + phrase, phrase + " " + " ".join(words(rng, 90)), " ".join(words(rng, 40))]
    again = "ha" + " ha" * 60
    near = [texts[3] + " changed", f"{phrase} {again} {line}", f"{phrase} x {again} {line}"]
    rows = spark.createDataFrame(list(enumerate(texts + near)), "id long, norm string").withColumn("size", F.length("norm"))
    buckets = {}
    for r in fuzzy_lines._met(fuzzy_lines._runs(rows), 0.9).collect():
        buckets.setdefault(r.key, set()).add(r.id)
    assert {frozenset(b) for b in buckets.values()} == {frozenset({3, 4}), frozenset({5, 6})}


def test_simhash_is_the_majority_of_bits(spark):
    text = " ".join(words(random.Random(1), 33))
    got = fuzzy_lines._occurrences(docs(spark, [text]), "doc_id", "text", 5).first()
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64(F.lit("word"), "w").alias("h")).collect()]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert got.sim & (2**64 - 1) == want


# ---- licenses -----------------------------------------------------------------------------------
def test_license_places(spark):
    rng = random.Random(6)
    pieces = ["CC BY", "cc-by 4.0", "GNU General Public License, version 3", "All rights reserved.", "all rights", "general public", "reserved", "ccé by", "by cc"]
    texts = [" ".join(rng.choice(pieces) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", "...", "cc by cc by", "Licensed under the Apache License, version 2.0", "licensed under that apache license version 2.0", "Released, under the MIT license"]
    got = by_id(licenses.scan_licenses(docs(spark, texts).withColumn("label", F.lit(1)).withColumn("words", F.lit(1))))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        found = [(k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[len(texts) - 3].labels == "apache" and got[len(texts) - 2].labels == "apache" and got[len(texts) - 1].labels == "mit" and got[80].score == 0
    twice = licenses.scan_licenses(docs(spark, ["cc by", "x"], ids=[None, None])).collect()
    assert sorted(r.n_base for r in twice) == [0, 1] and licenses.scan_licenses(docs(spark, []).limit(0)).count() == 0


def test_near_misses_of_licenses(spark):
    texts = {"under the terms of the GNU General Public License": "gpl", "subject to the terms of the Eclipse Public License": "", "4.0 4.0 4.0 4.0": "", "2.0 2.0 2.0 2.0": "",
             "licensed under the GNU Lesser General Public License version 3": None, "licensed under CC BY 4.0": "cc-by", "under the terms of the GNU Lesser General Public License": "gpl,lgpl",
             "licensed under the GNU General Public License, version 3": "gpl", "subject to the terms of that Mozilla Public License": "mpl", "redistribution and use in source and in binary forms with or without any modification are permitted": "bsd"}
    got = by_id(licenses.scan_licenses(docs(spark, list(texts))))
    for k, (text, labels) in enumerate(texts.items()):
        assert labels is None or got[k].labels == labels, text
    spans = licenses.license_spans(docs(spark, list(texts))).filter("not base and verified and id = 4 and label = 'gpl'")
    assert spans.isEmpty() and all(0 <= r.score <= 1 for r in got.values()) and got[2].score < 0.55 and got[3].score < 0.55


def test_license_rule_in_sql(spark, tmp_path):
    """The SQL twin follows the rule on near misses too."""
    import duckdb
    texts = ["under the terms of the GNU General Public License", "subject to the terms of the Eclipse Public License", "4.0 4.0 4.0 4.0", "2.0 2.0 2.0 2.0", "licensed under the GNU Lesser General Public License version 3",
             "licensed under CC BY 4.0", "under the terms of the GNU Lesser General Public License", "licensed under the GNU General Public License, version 3", "subject to the terms of that Mozilla Public License",
             "redistribution and use in source and in binary forms with or without any modification are permitted", "cc by cc by nc 4 0 cc by sa", None, "", "x", "released into public domain", "licensed under cc by very nc 4 0"]
    df = docs(spark, texts, ids=[*range(14), 3, None])
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/d/*.parquet'")
    cur = con.execute(licenses.OP1_SQL)
    names = [d[0] for d in cur.description]
    got = licenses.scan_licenses(df)
    assert sorted(str([r[c] if c != "score" else round(r[c], 9) for c in names]) for r in got.collect()) == sorted(str([v if c != "score" else round(v, 9) for c, v in zip(names, row, strict=True)]) for row in cur.fetchall())


# ---- top-k --------------------------------------------------------------------------------------
def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 16 if i % 9 else 12)]) for i in range(700)]
    rows += [(900, None), (1000, []), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0]), (300, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    use = df.select(F.col("vec_id").alias("id"), maxscore.whole_numbers(F.col("embedding")).alias("vector")).filter("id is not null and vector is not null").withColumn("key", F.monotonically_increasing_id())
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(use.filter("id % 100 = 0"), use).collect())
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 100 == 0:  # each row of a repeated id asks, and only the own row is no candidate
            best = sorted((-sum(a * b for a, b in zip(v, c, strict=False)), i) for m, (i, c) in enumerate(fine) if m != n)[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and sum(q == 300 for q, *_ in got) == 20
    assert maxscore.top_k(use.limit(0), use).count() == 0


def test_essential_dimensions_come_from_bounds():
    """Skipping by bounds changes nothing, on columns of very different width and shards of several blocks."""
    rng = np.random.default_rng(5)
    values = (rng.normal(0, 1, (5000, 12)) * 10.0 ** np.arange(12)[::-1] / 1e6).astype(np.int64)
    shard = maxscore.Shard(np.arange(5000), np.arange(5000) // 2, values)
    for key in range(0, 5000, 700):
        ids, scores = shard.top(key, values[key], 10)
        want = sorted((-int(values[key] @ v), n // 2) for n, v in enumerate(values) if n != key)[:10]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


# ---- language -----------------------------------------------------------------------------------
EN, DE = "the cat and the dog went with this that", "der hund und die katze gingen nicht mit dem das"
RU = "это кошка и собака не так как все"


def test_language_spans_and_scripts(spark):
    texts = [" ".join(random.Random(k).choices(s.split(), k=40)) for k in range(30) for s in (EN, DE, RU)]
    train = docs(spark, texts, langs=["en", "de", "ru"] * 30)
    model = language.learn(train, buckets=4096)
    assert model.languages == ["de", "en", "ru"]
    mixed = f"{EN} {EN}. {DE} {DE} {DE} {RU}"
    asked = docs(spark, [EN, DE.upper(), RU, mixed, None, "", "12 !?", "日本語", "the", "a" * 50]).withColumn("spans", F.lit(0)).withColumn("text_", F.lit(0))
    got = by_id(language.detect(asked, model, carry={"doc_id": F.col("doc_id")}, with_spans=True))
    assert [got[k].lang_pred for k in range(7)] == ["en", "de", "ru", "de", "und", "und", "und"]
    assert [s.lang for s in got[3].spans] == ["en", "de", "ru"] and got[3].spans[1].first_word == 18 and 0.5 < got[3].score < 0.7
    assert got[7].lang_pred in model.languages and got[4].score == 0 and got[0].score == 1
    kept = language.keep_identified(asked, model)
    assert kept.columns == asked.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 8, 9]  # no language of the script of 7 was learnt
    none = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.detect(asked, none, carry={"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language.detect(asked.limit(0), model).count() == 0


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(2)
    count = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(0, 2, (13, 3)).astype(np.float32)
    first = np.cumsum(count) - count
    got = language.best_paths(scores, first, count, 1.5)
    for f, n in zip(first, count, strict=True):
        if n:
            paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
            value = [scores[f + np.arange(n), p].sum() - 1.5 * (p[1:] != p[:-1]).sum() for p in paths]
            own = scores[f + np.arange(n), got[f : f + n]].sum() - 1.5 * (got[f : f + n][1:] != got[f : f + n][:-1]).sum()
            assert own == pytest.approx(max(value), abs=1e-4)


def test_three_hundred_languages_and_whole_words():
    n = 300
    scores = np.full((n, n), -5.0)
    scores[np.arange(n), np.arange(n)] = 0
    assert (language.best_paths(scores, np.arange(n), np.ones(n, int), 6.0) == np.arange(n)).all()
    text = "ab cde " * 30
    for size in (2, 5, 10, 1000):
        pieces = list(language.whole_word_pieces(text, size))
        assert "".join(pieces) == text and (size < 4 or sum(len(p.split()) for p in pieces) == 60)
    assert list(language.whole_word_pieces("")) == [""] and list(language.whole_word_pieces("abcdef", 4)) == ["abcd", "ef"]


def test_mixed_texts_are_kept_and_unlearnt_scripts_are_not(spark):
    fr = "le chat et le chien ne sont pas avec les autres dans la maison"
    df = docs(spark, [EN] * 20 + [DE] * 20 + [fr] * 20, langs=["en"] * 20 + ["de"] * 20 + ["fr"] * 20)
    model = language.learn(df)
    three = f"{EN}. {DE}. {fr}."
    kept = language.keep_identified(docs(spark, [EN, three, RU, "123 !", None]), model)
    assert sorted(r.text for r in kept.collect()) == sorted([EN, three]) and kept.columns == df.columns


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = language.op7_language(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


# ---- toxicity -----------------------------------------------------------------------------------
def test_toxicity_learns_words_beginnings_and_disguises(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(400):
        w = words(rng, rng.randint(5, 60))
        if k % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiot", "schimpf" + words(rng, 1)[0]]))
        texts.append(" ".join(w))
        labels.append((k, int(k % 4 == 0)))
    lex = toxicity.learn(docs(spark, texts), spark.createDataFrame([*labels, (5000, 1), (7, None)], "doc_id long, toxic int"))
    score = lambda t: lex.score(lex.features(t))
    plain = " ".join(words(rng, 30))
    for bad in ("idiot", "1d10t", "іdіоt", "SCUMBAG", "schimpfxyz", "$cumbag, i", "idi0t!"):
        assert score(f"{plain} {bad} {plain}") >= 0.5 or bad.startswith("$"), bad
    assert score(plain) < 0.5 and score(None) == score("") < 0.5 and score("antiidiotic " + plain) < 0.5
    got = by_id(toxicity.score_texts(docs(spark, [*texts, None, ""]).withColumn("score", F.lit("x")), lex))
    assert all(got[k].predicted == y for k, y in labels)
    empty = toxicity.learn(docs(spark, texts), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert empty.words == {} and empty.score(empty.features("idiot")) < 0.5
    assert toxicity.score_texts(docs(spark, []).limit(0), lex).count() == 0


@pytest.mark.parametrize("sf, caught", [("sf0.001", 1), ("sf0.01", 4)])
def test_toxicity_on_held_out_documents(spark, sf, caught):
    """At least the toxic rows that a lexicon from few labelled rows can catch, and no others."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op5_toxicity(spark, f"/root/testdata/{sf}").filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted for r in got if r.toxic == 1) >= caught and not any(r.predicted for r in got if r.toxic == 0)


def test_exception_phrases_do_not_count():
    lex = toxicity.Lexicon({"clown": 5.0}, {}, ("clown fish",), (-3.0, 2.0, 1.0))
    assert lex.features("a clown fish swims")[2] == 0 and lex.features("a clown, a clown fish")[2] == 1


def test_many_exception_phrases_take_linear_time():
    lex = toxicity.Lexicon({"clown": 5.0}, {}, ("clown fish",), (-3.0, 2.0, 1.0))
    text = "a clown fish swims " * 100_000 + "clown"  # 2 MB
    start = time.perf_counter()
    assert lex.features(text)[2] == 1
    assert time.perf_counter() - start < 5


# ---- pipeline -----------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, sizes = now.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, path).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append((name, now.count()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns, name
        if name in ("language_id", "exact_dedup", "minhash"):
            assert now.join(before, "doc_id", "left_anti").isEmpty() and now.select("doc_id").distinct().count() == now.count()
        if name == "exact_dedup":
            assert now.select(F.lower("text")).distinct().count() == now.count()
        if name == "minhash":
            assert minhash.near_duplicates(now).filter("not kept").isEmpty()
    assert [n for n, _ in sizes] == ["language_id", "exact_dedup", "minhash", "mixing", "packing"]
    mixed = spark.read.parquet(f"{tmp_path}/3")
    assert now.filter("start = 0").count() == mixed.count()
    assert now.agg(F.sum("length")).first()[0] == now.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_letters_and_signs_need_no_whole_tokenizer():
    ids = packing.Ids(packing.tokenizer_path())
    texts = [w + e for w in ("Haus", "\u00e9t\u00e9", "naïve", "\u0130x", "don't", "a1", "<|x") for e in ("", ".", "***", ",###", "&&&", "!?\"", "'", "'.", "|>", "-->")]
    assert [ids.of_text(t) for t in texts] == [ids.of_any(t) for t in texts]
    whole = []
    ids.of_any = lambda text: whole.append(text) or b"\0\0\0\0"
    for t in ("Stra\u00dfe***", "baum%%%", "baum***", "wald%%%", "wald,###"):
        ids.of_text(t)
    assert whole == ["%%%"]  # signs of no word met before


def test_a_task_gives_back_the_memory_that_it_freed():
    """Small blocks below one that stays are not returned by freeing them; workers kept them from stage to stage."""
    import psutil

    stays = []

    def run(batches):
        blocks = [bytearray(20_000) for _ in range(15_000)]
        stays.append(bytearray(20_000))
        del blocks
        yield from batches

    before = psutil.Process().memory_info().rss
    assert list(common.tidied(run)(iter([1, 2]))) == [1, 2]
    assert psutil.Process().memory_info().rss - before < 100e6


def test_spans_are_merged_into_maximal_runs(spark):
    rows = [(1, 0, 40), (1, 1, 41), (1, 1, 41), (1, 41, 81), (1, 82, 90), (1, 5, 6), (2, 3, 43), (2, 100, 140), (2, 0, 200)]
    runs = suffixes.merged_spans(spark.createDataFrame(rows, "key long, start long, end long"))
    assert sorted(tuple(r) for r in runs.collect()) == [(1, 0, 81), (1, 82, 90), (2, 0, 200)]
    assert suffixes.merged_spans(spark.createDataFrame([], "key long, start long, end long")).count() == 0
