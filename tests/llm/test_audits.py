"""Spelling variants, source divergence and license scans against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import LOWER, folders, run  # noqa: F401
from tidemark.llm import license_scan, source_divergence, spelling
from tidemark.llm.license_templates import PHRASES, TEMPLATES

DOCS = "doc_id long, text string, lang string, source string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = set()
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in links.items():
        if others and counts[best := min(others, key=lambda v: (-counts[v], v))] >= 2 * counts[w]:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(links[w]), counts.get(form.get(w))))
    return out


def brute_counts(rows):
    found = Counter()
    for i, text in rows:
        for word, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            found["null" if i is None else str(i), word.translate(LOWER)] += n
    words = Counter()
    for (i, word), n in found.items():
        h = zlib.crc32(f"{i}:{word}".encode())
        if h % 97 == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        words[word] += n
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("block", [3, 128])
def test_variants_are_those_of_brute_force(spark, block):
    g = random.Random(3)
    words = {"".join(g.choice("aab") for _ in range(g.randint(1, 7))) for _ in range(150)} | {"prefix" + "".join(g.choice("xyzä😀") for _ in range(4)) for _ in range(80)}
    words |= {"a" * 5000, "a" * 2500 + "b" + "a" * 2499, "a" * 4999, "é" * 9, "é" * 8, "zz", "z"}
    counts = {w: g.choice([3, 4, 7, 15, 15, 40, 100]) for w in sorted(words)}
    table = spark.createDataFrame([*counts.items(), (None, 5), ("", 5)], "word string, n long").repartition(5)
    got = spelling.variants(table, block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_variants(counts))
    assert spelling.variants(table.limit(0), block).count() == 0


def test_blocks_are_subdivided_and_find_each_pair_once(spark):
    words = spark.createDataFrame([("stem" + a + b + c, 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    tables = spelling.blocks(words, 40)
    assert len(tables) > 2
    for rows in tables:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("to") - F.col("from")).alias("open"))
        assert sizes.filter("n > 40 AND open > 1").count() == 0
    pairs = spelling.near_words(words, 40)
    assert pairs.count() == pairs.distinct().count() == 512 * 21


def test_runs_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 7)
    text = "Größe GRÖSSE éÀ x" + "y" * 40 + "-z " * 9
    assert spelling._runs(text) == Counter(w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_op11(spark, folders):  # noqa: F811
    got, rows = run(spark, folders, "op11_spelling_variants", "word", "form", "root", "n", "n_near", "form_n")
    assert Counter(map(tuple, got)) == Counter(brute_variants(brute_counts([r[:2] for r in rows["documents"]]))) and len(got) > 3


def test_words_lose_a_letter(spark):
    rows = [(k, "Größe straße Wandern wandern, abc " * 2) for k in range(300)] + [(None, "wandern"), (7, None), (8, ""), (1, "Größe straße")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Word int")
    got = spelling.count_words(docs, least_count=1)
    expected = Counter()
    for i, text in {r for r in rows if r[1]}:
        for word, n in Counter(w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text)).items():
            h = zlib.crc32(f"{'null' if i is None else i}:{word}".encode())
            expected[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += n
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in expected.items() if len(w) >= 5} and len(expected) > 8
    assert spelling.group_variants(docs).filter("word = 'wandern' AND root = word").count() == 1


# --- divergence


def brute_audit(rows, least, top):
    f = lambda p, q: (p - q) ** 2 // (p + q)
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        tf[lang, source].update(terms)
        df[lang].update(terms.keys())
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in sources:
            total.update({t: tf[lang, s][t] for t in kept})
        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}
        q, ps = p(total), {s: p(tf[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(ps[s][t], q[t]), t) for t in kept if tf[lang, s][t] and ps[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)}
    return out


def test_divergence_is_that_of_brute_force(spark):
    g = random.Random(8)
    vocabulary = ["ab", "Cd", "é", "日本", "x1y", "a-b", "Ö", "zz", "q", "Q"]
    rows = [(" ".join(g.choice(vocabulary[k % 4 :]) for _ in range(g.randint(0, 30))), g.choice(["en", "de", None]), g.choice(["hot", "hot", "s1", "s2", None])) for k in range(140)]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("rare words only", "xx", "two"), ("word " * 70_000 + "ab", "en", "s1")] + rows[:3]
    docs = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], f"{DOCS}, Term string, item int")
    got = source_divergence.audit(docs, least_docs=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_audit(rows, 4, 3))
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_tasks_and_shards_pass_on_what_they_hold(monkeypatch):
    import pyarrow as pa

    g = random.Random(6)
    rows = [(" ".join(g.choice("abcdefg") for _ in range(20)), g.choice("xy"), g.choice("stu")) for _ in range(60)]
    docs = pa.table(list(zip(*rows, strict=True)), names=["text", "lang", "source"])

    def shard(held):
        monkeypatch.setattr(source_divergence, "HELD_ROWS", held)
        counts = pa.Table.from_batches(source_divergence._count(docs.to_batches(max_chunksize=7)))
        by = counts.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).to_pylist()
        kept = pa.Table.from_batches(source_divergence._kept(10)(counts.sort_by([("lang", "ascending"), ("term", "ascending")]).to_batches(max_chunksize=4)))
        return counts.num_rows, sorted(map(str, by)), sorted(map(str, kept.to_pylist()))

    few, many = shard(5), shard(1000)
    assert few[0] > many[0] and few[1:] == many[1:] and few[2]


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_shards_are_cut_between_terms(rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "HELD_ROWS", rows)
    table = pa.table({"lang": ["a"] * 8, "term": list("rrsstttt"), "n": [1] * 8})
    for size in (1, 2, 8):
        parts = list(source_divergence._whole_terms(table.to_batches(max_chunksize=size)))
        assert pa.concat_tables(parts).equals(table) or pa.concat_tables(parts).to_pylist() == table.to_pylist()
        ends = [set(p["term"].to_pylist()) for p in parts]
        assert all(not a & b for k, a in enumerate(ends) for b in ends[k + 1 :])


def test_op12(spark, folders):  # noqa: F811
    got, rows = run(spark, folders, "op12_source_divergence", "lang", "source", "part", "item", "value", "rank")
    assert Counter(map(tuple, got)) == Counter(brute_audit([r[1:4] for r in rows["documents"]], 10, 10))


# --- licenses


def as_pattern(markup):
    """The regular expression of a template over words that a space follows."""
    out = ""
    for kind, value in license_scan._tokens(markup):
        if kind == "words":
            out += "".join(re.escape(w.decode()) + " " for w in license_scan.words(value))
        elif kind == "gap":
            out += rf"(?:\S+ ){{{value[0]},{value[1]}}}"
        elif kind == "any":
            out += "(?:" + "|".join("".join(re.escape(w.decode()) + " " for w in license_scan.words(c)) for c in value) + ")"
        else:
            out += "(?:" if kind == "beginOptional" else ")?"
    return out


def brute_matches(templates, text):
    """(first word, word after the longest match, template), by trying each end of each start."""
    w = [x.decode() for x in license_scan.words(text)]
    found = []
    for k, t in enumerate(templates):
        pattern = re.compile(as_pattern(t.markup))
        for i in range(len(w)):
            ends = [j for j in range(i + 1, len(w) + 1) if pattern.fullmatch("".join(x + " " for x in w[i:j]))]
            if ends:
                found.append((i, max(ends), k))
    return sorted(found)


MADE = [
    license_scan.Template("one", 'grant <<beginOptional>>very <<beginOptional>>free <<endOptional>><<endOptional>>use of <<var;words="0-3">> end'),
    license_scan.Template("two", '<<beginOptional>>by <<var;words="1-2">> <<endOptional>>use <<any="of|all of|">> end'),
    license_scan.Template("three", 'of <<beginOptional>>all <<endOptional>>end <<any="grant|very free">>'),
    license_scan.Template("phrase", "use of", base=True),
]


def test_matches_are_those_of_brute_force(monkeypatch):
    g = random.Random(4)
    automaton = license_scan.Automaton(MADE)
    monkeypatch.setattr(license_scan, "PIECE", 20)
    monkeypatch.setattr(license_scan, "KEPT_SETS", 12)
    seen = Counter()
    for _ in range(400):
        text = " ".join(g.choice(["grant", "Very", "free", "use", "OF", "of", "end", "by", "all", "x1"]) + g.choice(["", ",", "\n"]) for _ in range(g.randint(0, 40)))
        n, found = automaton.find(text)
        assert (n, sorted(found)) == (len(license_scan.words(text)), brute_matches(MADE, text))
        seen.update(k for _, _, k in found)
    assert len(seen) == 4


def test_the_longest_wording_wins():
    assert license_scan.widest([(0, 5, 1), (0, 5, 2), (1, 4, 3), (3, 9, 4), (9, 10, 5), (0, 2, 6)]) == [(0, 5, 1), (0, 5, 2), (3, 9, 4), (9, 10, 5)]
    automaton = license_scan.Automaton([license_scan.Template(k, m) for k, several in TEMPLATES.items() for m in several])
    labels = lambda t: {automaton.templates[k].label for _, _, k in license_scan.widest(automaton.find(t)[1])}
    assert labels("This program is licensed under the GNU General Public License, version 3 or (at your option) any later version.") == {"GPL-3.0-or-later"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"GPL-3.0-only"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"} and labels("licensed under CC BY-NC-SA 4.0") == {"CC-BY-NC-SA-4.0"}
    assert labels("# SPDX-License-Identifier: BSD-3-Clause") == {"BSD-3-Clause"} and labels("under the GNU General Public License version 3") == set()


@pytest.mark.parametrize("label", list(TEMPLATES))
def test_templates_accept_their_wording(label):
    for markup in TEMPLATES[label]:
        for optional in (True, False):
            text, depth = [], 0
            for kind, value in license_scan._tokens(markup):
                depth += {"beginOptional": 1, "endOptional": -1}.get(kind, 0)
                if optional or not depth:
                    text += [value] if kind == "words" else [next(c for c in value if c)] if kind == "any" else ["some one"] * (kind == "gap")
            n, found = license_scan.Automaton([license_scan.Template(label, markup)]).find(" ".join(text))
            assert (0, n, 0) in found
            # another word in place of a mandatory one
            broken = [w.decode() for w in license_scan.words(" ".join(text))]
            broken[-1] = "qqq"
            assert (0, n, 0) not in license_scan.Automaton([license_scan.Template(label, markup)]).find(" ".join(broken))[1] or "words=" in markup[-20:]


@pytest.mark.parametrize("markup", ["<<beginOptional>>a", "a<<endOptional>>", "<<other>> a", '<<var;words="1-900">> a', "<<beginOptional>>a<<endOptional>>"])
def test_wrong_markup_is_an_error(spark, markup):
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([], DOCS), templates={"x": [markup]})


def test_op13(spark, folders):  # noqa: F811
    got, rows = run(spark, folders, "op13_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert len(got) == len(rows["documents"]) and all(r["score"] == 0 and not r["labels"] for r in got)


def test_licenses_of_documents(spark):
    texts = ["Released under the MIT License.", "The Apache License, or a Mit-license and an MIT\nLICENSE", None, "", "mit licenses", "GNU General  Public License", "x " * 300_000 + "Licensed under the Apache License, Version 2.0. " + "y " * 300_000, "Released under the MIT License."]
    docs = spark.createDataFrame([(k, t, "l", "s", "n") for k, t in enumerate(texts)], f"{DOCS}, Labels string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert license_scan.scan(docs).columns == ["doc_id", "text", "lang", "source", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    brief = lambda k: tuple(got[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert brief(0) == brief(7) == (5, 1, 3, 3, "mit", "MIT,mit") and brief(1) == (11, 3, 1, 9, "apache,mit", "apache,mit")
    assert brief(2) == brief(3) == (0, 0, None, None, "", "") and brief(4) == (2, 0, None, None, "", "") and brief(5) == (4, 1, 1, 1, "gpl", "gpl")
    assert brief(6) == (600_008, 1, 300_003, 300_003, "apache", "Apache-2.0,apache")
    assert [tuple(s) for s in got[6]["spans"]] == [("Apache-2.0", 300_000, 8)]
    assert got[2]["score"] == 0 and 0 < got[5]["score"] < got[6]["score"] < 1
    assert license_scan.scan(docs.limit(0)).count() == 0 and set(PHRASES.values()) == {"mit", "apache", "gpl"}
