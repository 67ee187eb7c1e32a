"""License alignment against brute force, and recall on licenses with words put in, taken out and replaced."""

import random

import numpy as np
import pytest

from quillon.llm import license_scan as ls

FILLER = "lorem ipsum dolor amet consectetur elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud".split()


def brute_ends(template, words, band, gap):
    """{end: (worth, first)} of the best in-order matching that ends at each word, every pair of places tried."""
    cells = {}  # (i, j) -> (worth, first)
    for j, w in enumerate(words):
        for i, t in enumerate(template):
            if not w or w != t:
                continue
            best = (ls.UNIT, j)
            for (a, b), (worth, first) in cells.items():
                if a < i and b < j and j - b - 1 <= gap:
                    skipped = j - b - 1
                    best = max(best, (worth + ls.UNIT - skipped * ls.SKIP - (skipped > band) * (ls.JUMP * ls.UNIT + 1), first), key=lambda x: x[0])
            cells[i, j] = best
    out = {}
    for (_, j), c in cells.items():
        out[j] = max(out.get(j, c), c, key=lambda x: x[0])
    return out


def brute_best(template, words, band, gap, least=0):
    """(end, worth, first) of the best that matches ``least`` words; the first of equals."""
    ends = {j: c for j, c in brute_ends(template, words, band, gap).items() if ls.unpack(c[0])[0] >= least}
    if not ends:
        return None
    top = max(c[0] for c in ends.values())
    return min((j, *c) for j, c in ends.items() if c[0] == top)


def brute_alignments(template, words, least, band, gap):
    """The best, then the same on both sides of it."""
    found = brute_best(template, words, band, gap, least)
    if found is None:
        return []
    j, worth, first = found
    left, right = brute_alignments(template, words[:first], least, band, gap), brute_alignments(template, words[j + 1 :], least, band, gap)
    return [*left, (ls.unpack(worth)[0], first, j + 1), *((m, a + j + 1, b + j + 1) for m, a, b in right)]


def test_worths_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        template = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))]
        words = [rng.randrange(0, 6) for _ in range(rng.randrange(1, 16))]
        band, gap = rng.choice([(0, 0), (1, 3), (2, 6), (4, 4)])
        ends = ls.worths(template, words, band, gap)
        want = brute_best(template, words, band, gap)
        if want is None:
            assert ends.max() < 0
        else:
            assert ends.max() == want[1] and int(ends.argmax()) == want[0]
            matched, skipped = ls.unpack(int(ends.max()))
            assert want[0] + 1 - matched - skipped == want[2]


def test_alignments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        template = [rng.randrange(1, 8) for _ in range(rng.randrange(3, 7))]
        words = np.array([x for _ in range(3) for x in [*rng.sample(range(0, 8), rng.randrange(0, 4)), *template[: rng.randrange(2, 8)]]])
        least = 0.8 * len(template)
        got = sorted(ls.alignments(template, words, 0, len(words), least, 1, 2), key=lambda x: x[1])
        assert got == brute_alignments(template, words.tolist(), least, 1, 2)


def edited(rng, words, inserts, deletes, replaces, run):
    words = list(words)
    for _ in range(deletes):
        words.pop(rng.randrange(len(words)))
    for _ in range(replaces):
        words[rng.randrange(len(words))] = rng.choice(FILLER)
    places = sorted((rng.randrange(1, len(words)) for _ in range(inserts // run)), reverse=True)
    for at in places:
        words[at:at] = [rng.choice(FILLER) for _ in range(run)]
    return words


@pytest.mark.parametrize("run", [1, 7, 12, 60])
def test_recall_of_edited_licenses(run):
    """Up to 60 words put in (in runs of 1 to 60), and up to a tenth taken out or replaced."""
    rng, scanner, found, all_ = random.Random(run), ls.Scanner(ls.TEMPLATES), 0, 0
    for name in [n for n, t in ls.TEMPLATES.items() if len(ls.plain_words(t)) >= ls.LONG]:
        for _ in range(4):
            template = ls.TEMPLATES[name].split()
            few = len(template) // 20
            lost = rng.randrange(few + 1), rng.randrange(few + 1)
            words = edited(rng, template, rng.choice([0, 60]), *lost, run)
            before, own = " ".join(rng.choices(FILLER, k=80)) + " ", " ".join(words)
            text = f"{before}{own} {' '.join(rng.choices(FILLER, k=80))}"
            got = scanner.scan(text)
            all_ += 1
            best = max(got, key=lambda g: g["matched_words"], default=None)
            if best and best["license"] == name:
                found += 1
                assert len(before) <= best["start"] < best["end"] <= len(before) + len(own)
                assert best["coverage"] * best["template_words"] >= best["template_words"] - sum(lost) - 2 * ls.JUMP - 2
    assert found >= 0.9 * all_


def test_inserted_clause_costs_no_coverage():
    scanner, words = ls.Scanner(ls.TEMPLATES), ls.TEMPLATES["MIT"].split()
    for n in (0, 6, 7, 12, 60):
        text = " ".join([*words[:80], *(FILLER * 4)[:n], *words[80:]])
        got = scanner.scan(text)
        assert [(g["license"], g["coverage"]) for g in got] == [("MIT", 1.0)]
        assert (got[0]["start"], got[0]["end"]) == (0, text.rindex("SOFTWARE") + 8)


def test_longer_notice_wins():
    scanner = ls.Scanner(ls.TEMPLATES)
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0", "ISC", "Apache-2.0", "EPL-2.0"):
        assert [(g["license"], g["coverage"]) for g in scanner.scan(f"Head line. {ls.TEMPLATES[name]} And more.")] == [(name, 1.0)]


def test_scan_of_a_long_text_of_licenses():
    scanner = ls.Scanner(ls.TEMPLATES)
    text = "\n".join(f"{i} {ls.TEMPLATES['MIT'] if i % 2 else ls.TEMPLATES['MIT-notice']}" for i in range(300))
    got = scanner.scan(text)
    assert len(got) == 300 and {g["coverage"] for g in got} == {1.0}


def test_whole_scan_equals_alignment_of_every_template(spark, data):
    """On the given documents: each template's alignment with the whole text, without fingerprints or regions."""
    scanner = ls.Scanner(ls.TEMPLATES)
    for (text,) in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        ids = np.array([scanner.number.get(w, 0) for w in ls.plain_words(text)], np.int64)
        want = []
        for t, template in enumerate(scanner.ids):
            gap = ls.gap_for(len(template))
            want += [(scanner.names[t], m) for m, _, _ in ls.alignments(template, ids, 0, len(ids), 0.8 * len(template), min(ls.BAND, gap), gap)] if len(ids) else []
        got = [(g["license"], g["matched_words"]) for g in scanner.scan(text)]
        assert set(got) <= set(want) and bool(got) == bool(want)
