"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import decontamination, license_scan, mixing, oracles, quality_rules, queries, simhash, token_counts, token_records, toxicity, url_filters, warc
from quillon.llm.storage import store
from quillon.llm.tokenizing import encoder, vocabulary_path
from quillon.llm.words import plain

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
WORDS = "ada ben cat dot elk fox gnu hen ibis jay kite lark mole newt owl pig quail rat seal toad vole wasp yak".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source) with every odd case."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(5, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(60)]
    out += [(60, None, None, None), (61, "", "en", "a"), (62, " \t\n\x0b ", "en", "b"), (63, prose(rng, 9000), "en", "a"), (64, "Ünï çødé \u00a0wörd\u2003x 日本語 🎉 <|endoftext|> 'll", "fr", "c")]
    out += [(100 + i, out[3][1], "en", "a") for i in range(6)]  # copies
    out += [(110, out[4][1].upper(), "en", "a"), (5, out[5][1], "en", "a"), (5, out[5][1], "en", "a"), (None, out[6][1], "en", "a"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with results and internals."""
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ("score", "kept", "fingerprint", "n_words", "edits", "epoch", "key", "start", "_fp", "_row", "fp", "digest", "n_tokens", "license", "item_id", "a", "b", "root", "path", "part")
    return d.withColumns({c: F.lit(f"own {c}") for c in extra}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def library(text):
    return encoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(rows):
    enc = encoder(VOCABULARY)
    for _, text, *_ in rows:
        assert list(enc.ids(text or "")) == library(text)
        assert enc.plain


def test_edits_equal_a_new_count(rows):
    rng, enc = random.Random(2), encoder(VOCABULARY)
    inserts = ["", "'", " ", "  \n", "s", "'s", " ll", "42", "日", "é!", "<|endoftext|>"]
    for _, text, *_ in rows[::3]:
        doc = token_counts.Document(enc, cur := (text or ""))
        for _ in range(8):
            pos, cut, ins = rng.randrange(0, len(cur) + 3), rng.choice([0, 0, 1, 2, 40, 500]), rng.choice(inserts)
            doc.edit(pos, cut, ins)
            pos = min(pos, len(cur))
            cur = cur[:pos] + ins + cur[pos + cut :]
            assert (doc.text, doc.tree.n_tokens, doc.tree.n_chars) == (cur, len(library(cur)), len(cur))


def test_edit_touches_little(rows):
    doc = token_counts.Document(encoder(VOCABULARY), rows[63][1])
    doc.edit(20_000, 3, "zebra")
    assert doc.reencoded < 60


def test_count_edited(spark, docs, rows, none):
    edits = spark.createDataFrame([(r[0], s, 4 * s, 2, "new ") for r in rows[:40] for s in (2, 1)], "doc_id long, seq int, pos int, del int, ins string")
    with_edits = token_counts.attach_edits(docs, edits)
    got = token_counts.count_edited(with_edits, VOCABULARY).collect()
    assert len(got) == len(rows)
    edited = {r[0] for r in rows[:40]}
    want = sorted((r[0] is None, r[0] or 0, len(library(r[1])), len(library(after(r[1], r[0] in edited)))) for r in rows)
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["n_tokens"], g["n_tokens_after"]) for g in got) == want
    trees = token_counts.build_trees(with_edits, VOCABULARY)
    again = token_counts.count_edited(trees.withColumn("edits", F.lit(None).cast(token_counts.EDITS)), VOCABULARY, trees=True)
    assert again.agg(F.sum("n_tokens")).first()[0] == sum(w[2] for w in want)
    assert token_counts.count_edited(none.withColumn("edits", F.lit(None).cast(token_counts.EDITS)), VOCABULARY).count() == 0


def after(text, edited):
    text = text or ""
    for s in (1, 2) if edited else ():
        pos = min(4 * s, len(text))
        text = text[:pos] + "new " + text[pos + 2 :]
    return text


URLS = [None, "", "no scheme", "http://", "HTTP://Www.EXAMPLE.com/en/x?y#z", "https://a.example.com/en/1", "https://example.com/EN/", "http://x.net/fr/2", "http://net/es/", "https://sub.com", "https://sub.com/", "http://q.org/casino/", "http://q.org/casinos", "http://cheap-pills.org/", "http://cheap.org/cheap", "http://q.org/?u=http://www.example.com/en/", "http://ex.org/free#win", "x://y://z/free/bets", "http://nets.io/fr/", "http://a.b/\nfree\nbets"]


def test_url_filters(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.com/"), (3, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("own")).withColumn("terms", F.lit(1)).withColumn("_hit", F.lit(1))
    got = url_filters.filter_urls(pages.drop("_hit"))
    assert got.count() == len(rows)
    by = {r["url"]: r for r in got.collect()}
    assert (by["HTTP://Www.EXAMPLE.com/en/x?y#z"]["host"], by["HTTP://Www.EXAMPLE.com/en/x?y#z"]["rule"]) == ("www.example.com", "www.example.com/en/")
    assert by["https://a.example.com/en/1"]["verdict"] == "block" and by["https://example.com/EN/"]["rule"] == "com/"
    assert by["https://sub.com"]["rule"] is None and by["https://sub.com/"]["rule"] == "com/"
    assert by["http://q.org/casino/"]["verdict"] == "block" and by["http://q.org/casinos"]["verdict"] == "allow"
    assert by["http://cheap-pills.org/"]["verdict"] == "block" and by["http://cheap.org/cheap"]["verdict"] == "allow"
    assert by["http://nets.io/fr/"]["rule"] is None and by[None]["verdict"] == "allow" and by[None]["host"] == ""
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    sql = con.sql(oracles.url_filters())
    want = sorted(map(str, sql.select("page_id, host, path, rule, verdict, strict_hits, soft_hits").fetchall()))
    assert sorted(str(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"))) for r in got.collect()) == want
    assert url_filters.filter_urls(pages.drop("_hit").limit(0)).count() == 0


def test_toxicity_grammar():
    machine = toxicity.grammar()
    lexicon = toxicity.Lexicon({"idiot": 2.0, "scum$": 2.0})
    total = lambda t: sum(toxicity.clause_scores(t, lexicon, machine)[0])
    assert total("a plain day") == 0 and total(None) == 0 and total("") == 0
    assert total("idiot") == 2 and total("idiotic thing") == 2 and total("scumbag") == 0
    assert total("you idiot") > total("idiot") > total("not an idiot") > 0
    assert total("they said idiot") < total("they saw idiot")
    assert total("he said so. idiot") == total("idiot")  # reported speech ends with its clause
    assert len(toxicity.clause_scores("idiot. fine. scum!", lexicon, machine)[0]) == 2
    assert toxicity.clause_scores("idiot, " * 5000, lexicon, machine)[1] == 5000


def test_toxicity_learns(spark, data, docs, none):
    rng = random.Random(1)
    made = [(i, prose(rng, 30) + (" you grubling fool " if i % 4 == 0 else " "), int(i % 4 == 0)) for i in range(600)]
    texts = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made] + [(9999, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    scored = toxicity.score(texts, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").join(labels.where("toxic is not null"), "doc_id")
    assert scored.count() > 50 and scored.where("predicted <> toxic").count() == 0
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(texts.limit(0), labels)
    assert toxicity.score(texts.limit(3), empty).where("predicted = 0").count() == 3


def test_held_out_is_crc(spark):
    got = spark.range(40).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_warc(spark):
    long = "x" * 150
    rows = [(5, "http://a/\r\nInjected: 1", long), (2, "http://b/", long), (9, None, long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (7, "ü", "ö" * 60), (8, "u", "ö" * 60), (None, "u", long), (None, "u", "y" * 200), (2, "http://b/", long), (10, "u", "z" * 300_000), (11, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).withColumn("payload", F.lit("p"))
    got = [tuple(r) for r in warc.read_warc(warc.write_warc(pages)).drop("url").collect()]

    def want(page_id, html):
        data = (html or "").encode()
        group = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        first = min(group) if len(data) >= 100 and group else None
        visit = first is not None and page_id != first
        return page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if visit else "response", first if visit else None

    assert sorted(map(str, got)) == sorted(str(want(r[0], r[2])) for r in rows)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_file_format(tmp_path):
    import struct

    import zstandard

    out = warc.Writer(str(tmp_path), 0)
    for i in range(200):
        out.add(warc.record(i, f"http://h/{i}", (f"<html>{i} common words here</html>" * 3).encode(), "d", None, False, "2024-01-01T00:00:00Z"))
    out.close()
    raw = open(out.done[0][0], "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and size > 0
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
    assert opener.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert len(opener.unused_data) > 0  # each record is a frame of its own


def brute_mix(rows, exponent, seed, spark):
    import re

    keys = {tuple(r): r["k"] for r in spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, source string").distinct().select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "source").alias("k")).collect() for r in [r]}
    key = {(k[0], k[1]): k[2] for k in keys}
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, by = 0, {}
    for r in rows:
        by.setdefault(r[3], []).append((key[r[0], r[3]], n(r[1]), r[0]))
        total += n(r[1])
    size = {s: sum(x[1] for x in v) for s, v in by.items()}
    z = sum((size[s] / total) ** exponent for s in by if size[s])
    out = {}
    for s, v in by.items():
        if not size[s]:
            out[s] = {x[2]: 1 for x in v}
            continue
        quota = int(round((size[s] / total) ** exponent / z, 9) * total)
        passes, rest = divmod(quota, size[s])
        run, cut = 0, None
        for k in sorted({x[0] for x in v}):
            run += sum(x[1] for x in v if x[0] == k)
            if run <= rest:
                cut = k
        out[s] = {x[2]: passes + (cut is not None and x[0] <= cut) for x in v}
    return out


def test_mixing(spark, docs, rows, none):
    p = mixing.plan(docs, exponent=0.4, seed=3)
    got = mixing.realise(docs, p, seed=3)
    count = {(r["source"], r["doc_id"]): r["n"] for r in got.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect()}
    want = {(s, i): c * sum(1 for r in rows if r[0] == i and r[3] == s) for s, v in brute_mix(rows, 0.4, 3, spark).items() for i, c in v.items() if c}
    assert count == want
    b = mixing.blocks(got, p, block_tokens=500)
    assert b.count() == got.count() and set(b.columns) == set(got.columns) | {"block", "position"}
    assert mixing.realise(none, mixing.plan(none, repeats=2.0)).count() == 0


def test_mixing_targets(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["big"] * 900 + ["mid"] * 90 + ["small"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = {r["_source"]: r for r in mixing.plan(docs, repeats=3.0).collect()}
    assert max(r["weight"] * 10_000 / r["tokens"] for r in p.values()) == pytest.approx(3.0, abs=1e-3)
    e = {r["_source"]: r["weight"] for r in mixing.plan(docs, entropy=0.7).collect()}
    import math

    assert -sum(w * math.log(w) for w in e.values()) == pytest.approx(0.7 * math.log(3), abs=1e-4)
    assert mixing.plan(docs, repeats=0.5).first()["exponent"] == 1.0
    with pytest.raises(ValueError):
        mixing.plan(docs)


def test_mixing_is_native(spark, docs):
    p = mixing.plan(docs, repeats=1.25)
    plan = mixing.blocks(mixing.realise(docs, p), p, block_tokens=100)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_license_scan(spark, docs, none):
    t = license_scan.TEMPLATES
    cut = t["MIT"].replace("merge, ", "").replace("publish, ", "Publish ONLY ")
    texts = [(1, f"Foo bar. {t['MIT']} tail"), (2, f"É {cut}"), (3, "Released under the MIT License.\n" * 3), (4, t["MIT"][:300]), (5, None), (6, ""), (7, "the of and to in is this"), (8, "x " * 20000 + t["GPL-3.0-notice"]), (8, t["CC-BY-NC-4.0-notice"].upper())]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("own")).withColumn("start", F.lit(1))
    got = license_scan.scan_licenses(d).orderBy("doc_id", "start").collect()
    found = [(r["doc_id"], r["license"]) for r in got]
    assert found == [(1, "MIT"), (2, "MIT"), (3, "MIT-notice"), (3, "MIT-notice"), (3, "MIT-notice"), (8, "CC-BY-NC-4.0-notice"), (8, "GPL-3.0-notice")]
    assert got[0]["coverage"] == 1.0 and 0.95 < got[1]["coverage"] < 1.0
    one = texts[0][1]
    assert one[got[0]["start"] : got[0]["end"]].startswith("Permission is") and one[got[0]["start"] : got[0]["end"]].endswith("SOFTWARE")
    assert license_scan.scan_licenses(docs).count() == 0 and license_scan.scan_licenses(none).count() == 0


def test_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        t = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))]
        w = [rng.randrange(0, 6) for _ in range(rng.randrange(1, 12))]
        lcs = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
        for i, a in enumerate(t):
            for j, b in enumerate(w):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a == b else max(lcs[i][j + 1], lcs[i + 1][j])
        assert license_scan.align(t, w, 0, band=12)[0] == lcs[-1][-1]


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(4)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        d = edit_distance_inside(p, t)
        found = decontamination.myers(p, t, 4)
        assert (found[0] if found else None) == (d if d <= 4 and (t or d <= 4) and t else None if d > 4 or not t else d)


def test_decontamination(spark, docs, none):
    rng = random.Random(8)
    items = [(i, prose(rng, 40)) for i in range(12)] + [(50, "too short"), (51, None), (None, prose(rng, 30)), (3, items_text := prose(rng, 25))]
    texts = []
    for i in range(60):
        item = rng.choice(items[:12])[1]
        chars = list(item)
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(at, rng.choice("qz")), lambda: chars.insert(at, "q"), lambda: chars.pop(at)])()
        texts.append((i, prose(rng, 20) + " " + "".join(chars).upper() + " " + prose(rng, 20)))
    texts += [(60, None), (61, ""), (62, items_text), (0, texts[0][1])]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("own")).withColumn("h", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r["doc_id"], str(r["item_id"]), r["distance"]) for r in decontamination.find_leaks(d, bench).collect())
    want = []
    for i, t in texts:
        for item, q in items:
            p = plain(q)
            if len(p) >= decontamination.LEAST_CHARS and t and (e := edit_distance_inside(p, plain(t))) <= decontamination.budget(len(p)):
                want.append((i, str(item), e))
    assert got == sorted(want) and len(want) > 20
    clean = {r["doc_id"] for r in decontamination.decontaminate(d, bench).collect()}
    assert clean == {t[0] for t in texts} - {w[0] for w in want}
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.find_leaks(none, bench).count() == 0
    blocks = decontamination.item_blocks(bench, block_bytes=300)
    assert len(blocks) > 3 and sum(map(len, blocks)) == 14


def brute_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(rows):
    rng = random.Random(6)
    texts = [r[1] for r in rows] + ["a b c d e f g h " * 4, "x\n" * 9, "a #b |c| $<>&%*\n\n \n a #b |c| $<>&%*", " ".join(rng.choice("ab") for _ in range(400)), "\u2003a\u00a0b\x1c c"]
    for t in texts:
        assert quality_rules.measure_text(t) == brute_measures(t)


def test_quality_bins(spark):
    values = list(range(0, 5000)) + [2**k + d for k in range(13, 40) for d in (-1, 0, 1)]
    b = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bin_of(F.col("v")).alias("b")).withColumn("e", quality_rules.edge_of(F.col("b"))).orderBy("v").collect()
    assert all(r["e"] <= r["v"] < r["e"] * (1 + 1 / 32) + 1 for r in b)
    assert all(x["b"] <= y["b"] for x, y in zip(b, b[1:], strict=False))


def test_quality_rules(spark, docs, rows, none):
    got = quality_rules.assess(docs)
    assert got.count() == len(rows) and got.where("kept is null or base_failed is null or (kept and base_failed)").count() == 0
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    unique = [(i, *r[1:]) for i, r in enumerate(rows)]  # SQL groups by id
    con.executemany("insert into documents values (?, ?, ?, ?)", unique)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    mine = quality_rules.assess(spark.createDataFrame(unique, "doc_id long, text string, lang string, source string"), ).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, mine)) == sorted(con.sql(oracles.quality_rules()).select(columns).fetchall())
    assert quality_rules.assess(none).count() == 0


def brute_simhash(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """{row: smallest id}: single linkage at three bits over (id, fingerprint)."""
    out, todo = {}, set(range(len(pairs)))
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            front = {j for j in todo for i in front if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3}
            todo -= front
        ids = [pairs[i][0] for i in group if pairs[i][0] is not None]
        out |= {i: min(ids) if ids else None for i in group}
    return out


def test_simhash(docs, rows, none):
    got = sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect())
    prints = [(r[0], brute_simhash(r[1])) for r in rows]
    comp = brute_components(prints)
    assert got == sorted(str((i, f"{f:016x}", comp[k])) for k, (i, f) in enumerate(prints))
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns or set(stay.columns) == set(docs.columns)
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(str(c) for c in {str(comp[k]): comp[k] for k in comp}.values())
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links(spark, monkeypatch):
    """Chains and dense groups of fingerprints, in squares of four."""
    monkeypatch.setattr(simhash, "SQUARE", 4)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
            fps.add(at)
    pairs = list(enumerate(sorted(fps)))
    rows = spark.createDataFrame([(i, simhash._signed(f)) for i, f in pairs], "doc_id long, fp long")
    got = {r["fp"]: r["first"] for r in simhash.classes(rows, F.min("doc_id")).collect()}
    want = brute_components(pairs)
    assert got == {simhash._signed(f): want[k] for k, (_, f) in enumerate(pairs)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 3)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_token_records(spark, docs, rows, none):
    manifest = token_records.write_records(docs, VOCABULARY)
    got = sorted(token_records.read_records(manifest).collect(), key=lambda r: r["start"])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    assert [r["doc_id"] for r in got] == [rows[k][0] for k in order]
    at, tokens = 0, {}
    for r in rows:
        ids = [*library(r[1]), 2]
        tokens.setdefault(r[0], []).append((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in tokens[r["doc_id"]]
        tokens[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    s = token_records.shuffled(manifest, 1).orderBy("slot").collect()
    assert len(s) == len(rows) and [r["doc_id"] for r in s] != [r["doc_id"] for r in got]
    full = {r[0]: [*library(r[1]), 2] for r in rows}
    assert all(list(r["ids"]) == full[r["doc_id"]] for r in s if r["doc_id"] is not None)
    assert token_records.read_records(token_records.write_records(none, VOCABULARY)).count() == 0


def test_damaged_records_are_noticed(tmp_path):
    import io
    from array import array

    good = token_records.frame(7, array("I", [1, 2, 70000]))
    assert token_records.unframe(token_records.read_record(io.BytesIO(good)))[0] == 7
    for k in (0, 9, 13, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_records.read_record(io.BytesIO(good[:-3]))


def test_store_survives(spark):
    kept = store(spark.range(5), "test")
    assert kept.count() == 5 and "Range" not in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_query(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    rows = out.count()
    if name in ("op1_token_counts", "op3_toxicity", "op8_quality_rules", "op9_simhash", "op10_token_records"):
        assert rows == n
    elif name in ("op2_url_filters", "op4_warc"):
        assert rows == spark.read.parquet(f"{data}/pages.parquet").count()
    else:
        assert rows > 0


INTERNAL = ("_source", "_tokens", "_key", "_s", "passes", "cut", "rest", "_range", "_e", "_r", "_base", "_before", "_w", "weight", "block", "_hit", "_rule", "_score", "_measures", "_lang", "symbols_lower", "word_length_upper", "_fp", "_row", "_dropped", "_f", "first", "_edits", "_edit_of", "_leaks", "h", "s", "tie")


def test_working_names_in_the_input(spark, docs):
    """Columns that are called like an operator's working columns come back as they were."""
    odd = docs.drop(*INTERNAL).withColumns({c: F.lit(f"own {c}") for c in INTERNAL})
    own = [F.col(c) for c in INTERNAL if c != "block"]
    as_given = tuple(f"own {c}" for c in INTERNAL if c != "block")
    n = odd.count()
    pages = odd.withColumn("url", F.lit("http://x.net/fr/")).withColumn("page_id", F.col("doc_id"))
    edits = spark.createDataFrame([(3, 0, 1, 1, "x")], "doc_id long, seq int, pos int, del int, ins string")
    planned = mixing.plan(odd, repeats=1.5)
    results = {
        "assess": (quality_rules.assess(odd), n),
        "keep": (quality_rules.keep(odd), quality_rules.assess(docs).where("kept").count()),
        "filter_urls": (url_filters.filter_urls(pages), n),
        "score": (toxicity.score(odd, toxicity.Model({}, [0.0] * 6)), n),
        "attach_edits": (token_counts.attach_edits(odd, edits), n),
        "drop_near_duplicates": (simhash.drop_near_duplicates(odd), simhash.drop_near_duplicates(docs).count()),
        "decontaminate": (decontamination.decontaminate(odd, spark.createDataFrame([(1, "none of the documents holds this item")], "item_id long, text string")), n),
        "realise": (mixing.realise(odd, planned), mixing.mix(odd, planned).count()),
        "blocks": (mixing.blocks(mixing.realise(odd, planned), planned, block_tokens=500), mixing.mix(odd, planned).count()),
    }
    for name, (got, rows_) in results.items():
        assert got.count() == rows_, name
        assert [tuple(r) for r in got.select(*own).distinct().collect()] == [as_given], name
    for name in ("keep", "drop_near_duplicates", "decontaminate"):
        assert results[name][0].columns == odd.columns, name
    mixed = mixing.mix(odd, planned)
    assert mixed.columns == odd.columns and {tuple(r) for r in mixed.select("epoch", "key", "n_tokens").collect()} == {("own epoch", "own key", "own n_tokens")}
    assert {tuple(r) for r in results["keep"][0].select("n_words", "kept").collect()} == {("own n_words", "own kept")}


def test_mixing_by_a_column_of_the_input(docs):
    """The measure of tokens may be a column that the mix replaces."""
    counted = docs.withColumn("n_tokens", F.lit(7).cast("long"))
    p = mixing.plan(counted, exponent=1.0, tokens=F.col("n_tokens"))
    got = mixing.realise(counted, p, tokens=F.col("n_tokens"))
    assert {r["n_tokens"] for r in got.collect()} == {7}
    sizes = {r["source"]: 7 * r["n"] for r in counted.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert {r["_source"]: r["tokens"] for r in p.collect()} == sizes


def test_short_items_are_found_between_word_boundaries(spark):
    bench = spark.createDataFrame([(1, "Is it, so?"), (1, "is it so"), (2, "ada"), (3, ""), (4, "?!"), (5, None), (6, "ada ben cat dot elk fox gnu hen")], "item_id long, text string")
    texts = [(1, "well, is it so"), (2, "this it so"), (3, "IS IT SO. ada"), (4, "adam"), (5, "is it sore"), (6, None), (7, "ada"), (8, "-ada-"), (9, "is it also is  it\nso")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = []
    for i, t in texts:
        for item, q in bench.collect():
            if (p := plain(q)) and len(p) < decontamination.LEAST_CHARS and f" {p} " in f" {plain(t)} ":
                want.append((i, item, 0))
    got = [tuple(r) for r in decontamination.find_leaks(docs, bench).select("doc_id", "item_id", "distance").collect()]
    assert sorted(got) == sorted(want) and len(want) == 9
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {2, 4, 5, 6}


def test_many_item_blocks_in_one_scan(spark, monkeypatch):
    """However many blocks there are, the plan reads the documents once and gives the same rows."""
    rng = random.Random(12)
    bench = spark.createDataFrame([(i, prose(rng, 12)) for i in range(60)] * 2, "item_id long, text string")
    items = [r["text"] for r in bench.collect()]
    docs = spark.createDataFrame([(i, prose(rng, 15) + " " + rng.choice(items) + " " + prose(rng, 900 if i < 3 else 15)) for i in range(80)], "doc_id long, text string").repartition(2)
    few = sorted(map(tuple, decontamination.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination.item_blocks, "__kwdefaults__", decontamination.item_blocks.__kwdefaults__ | {"block_bytes": 300})
    monkeypatch.setattr(decontamination, "BUFFER_BYTES", 3000)
    many = decontamination.find_leaks(docs, bench)
    assert len(decontamination.item_blocks(bench)) > 8
    assert sorted(map(tuple, many.collect())) == few and len(few) >= 160
    assert many._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2


def brute_blocks(rows, planned, block_tokens, seed, slots):
    """{(source, epoch, key): (block, position)} of (source, epoch, key, n_tokens) rows; ``slots`` hashes (block, key, source)."""
    import math

    weight = {r["_source"]: r["weight"] for r in planned}
    every = max(1, math.ceil(sum(r["quota"] for r in planned) / block_tokens))
    block, before = {}, {}
    for s, e, k, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        at = before.get(s, 0)
        block[s, e, k] = int(at // (weight[s] * block_tokens)) if weight[s] > 0 else k % every
        before[s] = at + n
    hashed, place, out = slots(block), {}, {}
    for row in sorted(block, key=lambda r: (block[r], hashed[r])):
        out[row] = block[row], place.get(block[row], 0)
        place[block[row]] = place.get(block[row], 0) + 1
    return out


def test_blocks_equal_brute_force(spark):
    """With a hot id, a null source, a source without words, and rows of no words."""
    rng = random.Random(9)
    made = [(i if i % 3 else None, prose(rng, rng.randrange(0, 40)), rng.choice(["a", "a", "b", None])) for i in range(700)]
    made += [(i, "", "wordless") for i in range(120)] + [(5, "one two", "b")] * 4
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    p = mixing.plan(docs, exponent=0.2, seed=3)
    mixed = mixing.realise(docs, p, seed=3)
    got = mixing.blocks(mixed, p, block_tokens=900, seed=11).drop("text").collect()
    assert len(got) == mixed.count()

    def slots(block):
        rows = [(b, k, s, e) for (s, e, k), b in block.items()]
        df = spark.createDataFrame(rows, "block long, key long, source string, epoch int").withColumn("slot", F.xxhash64(F.lit(11), "block", "key", "source"))
        return {(r["source"], r["epoch"], r["key"]): r["slot"] for r in df.collect()}

    want = brute_blocks([(r["source"], r["epoch"], r["key"], r["n_tokens"]) for r in got], p.collect(), 900, 11, slots)
    assert {(r["source"], r["epoch"], r["key"]): (r["block"], r["position"]) for r in got} == want
    # passes are different permutations, sources alternate within a block, and blocks keep to their budget
    passes = {}
    for r in sorted(got, key=lambda r: r["key"]):
        if r["source"] == "b":
            passes.setdefault(r["epoch"], []).append(r["doc_id"])
    assert len(passes) > 1 and len({tuple(v) for v in passes.values()}) == len(passes)
    first = [r["source"] for r in sorted((r for r in got if r["block"] == 1), key=lambda r: r["position"])]
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) > len(first) / 3
    sizes = {}
    for r in got:
        sizes[r["block"]] = sizes.get(r["block"], 0) + r["n_tokens"]
    inner = [n for b, n in sizes.items() if b < max(sizes)]
    assert all(900 - 4 * 40 <= n <= 900 + 4 * 40 for n in inner)
    assert len([r for r in got if r["source"] == "wordless" and r["block"] == 0]) < 60


def test_url_weights(spark):
    terms = [url_filters.Term("bad", True), url_filters.Term("heavy", False, 2), url_filters.Term("mid", False, 2), url_filters.Term("light", False), url_filters.Term("faint", False)]
    hit = {"http://a.org/light/faint": (2, 2, "allow"), "http://a.org/heavy": (1, 2, "allow"), "http://a.org/heavy-light": (2, 3, "block"), "http://a.org/heavy/heavy/heavy": (1, 2, "allow"), "http://a.org/mid.heavy": (2, 4, "block"), "http://a.org/heavylight": (0, 0, "allow"), "http://a.org/bad": (0, 0, "block"), "x" * 100_000 + " light mid": (2, 3, "block")}
    got = url_filters.filter_urls(spark.createDataFrame([(u,) for u in hit], "url string"), terms=terms)
    assert {r["url"]: (r["soft_hits"], r["soft_weight"], r["verdict"]) for r in got.collect()} == hit
    assert len({t.text for t in url_filters.VOCABULARY}) == len(url_filters.VOCABULARY)
    assert all(0 < t.weight < url_filters.SOFT_LIMIT for t in url_filters.VOCABULARY if not t.strict)
    honest = ["http://a.org/free/win", "https://shop.org/track/order?free=1", "https://a.org/credit-cards", "http://a.org/free/dating"]
    assert {r["verdict"] for r in url_filters.filter_urls(spark.createDataFrame([(u,) for u in honest], "url string")).collect()} == {"allow"}


def brute_clauses(text, stems):
    """Clause scores by looking at every word's surroundings, without machines."""
    import re

    def kind(w):
        for k, words in (("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("target", toxicity.TARGETS), ("contrast", {",", *toxicity.CONTRASTS}), ("threat", toxicity.THREATS)):
            if w in words:
                return k, 1.0
        for s in (f"{w}$", *(w[:n] for n in (7, 6, 5) if len(w) >= n)):
            if s in stems:
                return "insult", stems[s]
        return "other", 0.0

    out = []
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        words = [kind(w) for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|,", clause)]
        total, harmful = 0.0, False
        for i, (k, w) in enumerate(words):
            if k not in ("insult", "threat"):
                continue
            harmful = True
            kinds = [x[0] for x in words]
            aimed = "target" in kinds[max(0, i - 5) : i] or "target" in kinds[i + 1 : i + 6]
            before = kinds[max(0, i - 3) : i]
            negated = "negation" in before and "contrast" not in before[len(before) - 1 - before[::-1].index("negation") :]
            told = "report" in kinds[:i]
            total += w * (2 if k == "threat" else 1) * (1.5 if aimed else 1) * (0.3 if negated else 1) * (0.5 if told else 1)
        if harmful:
            out.append(total)
    return out


def test_clauses_equal_brute_force():
    rng, stems, machine = random.Random(6), {"idiot": 2.0, "scum$": 1.5, "threat$": 1.25, "insult$": 0.5}, toxicity.grammar()
    lexicon = toxicity.Lexicon(stems)
    words = "idiot idiotic scum scumbag threat insult target other kill kills you they not never said but, , . ; \n a plain day time house don't"
    for n in [3, 6, 10, 20] * 100 + [30_000]:
        text = " ".join(rng.choices(words.split(" "), k=n))
        assert toxicity.clause_scores(text, lexicon, machine)[0] == pytest.approx(brute_clauses(text, stems))


def test_targets_on_both_sides():
    total = lambda t: sum(toxicity.clause_scores(t, toxicity.Lexicon({"idiot": 2.0}), toxicity.grammar())[0])
    assert total("kill you") == total("you kill") > total("kill time")
    assert total("idiots like you") > total("idiots")
    assert total("he is not here, you idiot") == total("you idiot") > total("you are not an idiot")
    assert total("not here but an idiot") == total("an idiot")
    assert total("she said that, well, an idiot") < total("an idiot")


def test_long_words_are_learned(spark):
    long = "grub" * 20
    made = [(i, f"plain text {i} " + (long if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int"))
    assert f"{long}$" in model.stems


def test_shuffled_is_a_full_permutation(spark, rows):
    """Every record once, in the order of the slots that a hash of file, offset and seed gives."""
    import struct

    d = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(300)], "doc_id long, text string").repartition(3)
    manifest = token_records.write_records(d, VOCABULARY)
    want = []
    for r in manifest.collect():
        with open(f"{r['path']}.idx".removeprefix("file:"), "rb") as f:
            offsets = [o for o, _ in struct.iter_unpack("<QQ", f.read())]
        with open(f"{r['path']}.rec".removeprefix("file:"), "rb") as f:
            for o in offsets:
                f.seek(o)
                doc_id, ids = token_records.unframe(token_records.read_record(f))
                want.append((r["path"], o, doc_id, ids.tolist()))
    keyed = spark.createDataFrame([(p, o, i) for p, o, i, _ in want], "path string, offset long, doc_id long")
    for seed in (1, 2):
        order = [r["doc_id"] for r in keyed.withColumn("slot", F.xxhash64("path", "offset", F.lit(seed))).orderBy("slot", "path", "offset").collect()]
        got = token_records.shuffled(manifest, seed).collect()
        assert [r["doc_id"] for r in got] == order and sorted(order) == list(range(300))
        ids = {i: x for _, _, i, x in want}
        assert all(r["ids"] == ids[r["doc_id"]] for r in got)


def test_toxicity_of_a_long_text():
    """Scores of a very long text are those of its clauses, one by one."""
    stems, machine = {"grubling$": 2.0, "scumb": 1.0}, toxicity.grammar()
    clauses = ["you grubling", "a plain day, not a grubling", "they said scumbag", "nothing here"] * 20_000
    lexicon = toxicity.Lexicon(stems)
    got = toxicity.clause_scores(". ".join(clauses), lexicon, machine)
    each = [toxicity.clause_scores(c, lexicon, machine)[0] for c in clauses[:4]]
    assert got[0] == [s for x in each for s in x] * 20_000 and got[1] == 60_000
