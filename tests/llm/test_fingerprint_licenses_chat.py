"""Fingerprints, licence scans and chat formatting against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import plain_words, spaced_words
from resight.llm import chat, fingerprint, licenses
from resight.llm.fingerprint import Sketch


def test_next_text(documents, odd_texts):
    order = sorted(((d is not None, d or 0, t or "") for d, t in odd_texts), key=lambda r: r[:2])
    ids = [(d if known else None, t) for known, d, t in order]
    for rows in (3, 1000):
        got = fingerprint.with_next_text(documents, rows=rows).collect()
        assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((d or -1, t) for d, t in ids)
        named = [(d, t) for d, t in ids if d is not None and d != 15]
        after = {d: ids[(ids.index((d, t)) + 1) % len(ids)][1] for d, t in named}
        # The last row is followed by one of the two rows without an id.
        loop = named[-1][0]
        for r in got:
            if r.doc_id in after and r.doc_id != loop:
                assert r.next_text == after[r.doc_id]
            if r.doc_id == loop:
                assert r.next_text in {t for d, t in ids if d is None}


def test_edited(spark):
    df = spark.createDataFrame([("abcde", "XYZ"), ("abcd", "X"), ("", "X"), ("🙂é🙂", "ß日")], "a string, b string")
    assert [r[0] for r in df.select(fingerprint.edited(F.col("a"), F.col("b"))).collect()] == ["abcXY", "abX", "", "🙂éß"]


def hashes(rng, n):
    return np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))


def test_sketches():
    rng = np.random.default_rng(1)
    sets = [hashes(rng, n) for n in (4000, 40)]
    big = Sketch.of(np.unique(np.concatenate(sets)))
    small, half = Sketch.of(sets[1]), Sketch.of(sets[0])
    assert small.complete() and not big.complete() and small.divisor == big.divisor == 4
    assert small.containment(big) == 1 and big.containment(small) < 0.1
    assert half.likeness(big) == pytest.approx(4000 / 4040, abs=0.02)
    assert str(Sketch.parse(str(big))) == str(big) and str(Sketch.parse(str(small))) == str(small)
    none = Sketch.of(sets[0][:0])
    assert str(none) == "0:4:0::" and none.likeness(none) == 1 and none.likeness(big) == 0 == none.likeness(small)


def test_the_merged_sketch_is_the_sketch_of_the_joined_set():
    rng = np.random.default_rng(7)
    for sizes in ((3, 5), (0, 20), (40, 40), (33, 32), (56, 56), (64, 64), (64, 1), (2996, 2996), (10, 2996), (0, 500), (65, 64)):
        one, two = (hashes(rng, n) for n in sizes)
        two = np.unique(np.concatenate([two, one[::3]]))
        joined = Sketch.of(np.unique(np.concatenate([one, two])))
        for a, b in ((one, two), (two, one)):
            assert str(Sketch.of(a).merged(Sketch.of(b))) == str(joined)
        assert Sketch.of(one).merged(Sketch.of(two)).likeness(joined) == 1
        third = Sketch.of(hashes(rng, 30))
        assert str(third.merged(Sketch.of(one)).merged(Sketch.of(two))) == str(third.merged(joined))


def test_likeness_of_the_query_against_exact_sets(spark, odd_texts):
    rng = random.Random(3)
    texts = [t or "" for _, t in odd_texts] + [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (30, 50, 90, 900, 5000, 9000)]

    def exact(text):
        w = spaced_words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = [(k, a, a[: len(a) // 2] + b[: len(a) // 2]) for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False))]
    frame = spark.createDataFrame(rows, "k long, a string, b string")
    got = {r.k: r.near for r in fingerprint.fingerprints(frame, {"a": "f", "b": "g"}, {"near": ("a", "b")}, ("k",)).collect()}
    for k, a, b in rows:
        one, two = exact(a), exact(b)
        true = len(one & two) / len(one | two) if one | two else 1.0
        small = max(len(one), len(two)) <= fingerprint.WHOLE
        assert got[k] == pytest.approx(true, abs=1e-12 if small else 4 * (true * (1 - true) * 3 / max(1, len(one | two))) ** 0.5 + 0.1), a[:50]


def test_equal_texts_have_equal_fingerprints(documents, odd_texts):
    rows = fingerprint.fingerprints(documents, {"text": "f"}, {"same": ("text", "text")}, ("doc_id", "text")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.f)
    assert len(rows) == len(odd_texts) and all(len(x) == 1 for x in by.values()) and {r.same for r in rows} == {1.0}


LICENCES = [
    (900, "All rights reserved. ALL RIGHTS RESERVED"), (901, "cc by"), (902, "Licensed under CC BY-NC 4.0."),
    (903, "text before\nReleased under the MIT License."), (904, "the GNU General Public License, version 3 here: licensed under the gnu general public license version 3"),
    (905, "mit license"), (906, "licensed under the apache"), (907, "Licensed under the Apache License, Version 2.0."), (908, "cc cc by by"),
]


def test_licences(spark, documents, odd_texts):
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(LICENCES, "doc_id long, text string"))
    got = licenses.scan(df).collect()
    want = []
    for doc, text in [*odd_texts, *LICENCES]:
        w, places, labels = plain_words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((doc or -1, len(w), sorted(places), sorted(labels)))
    assert sorted((r.doc_id or -1, r.n_words, list(r.base_places), list(r.base_labels)) for r in got) == sorted(want)
    labels = {r.doc_id: list(r.labels) for r in got}
    assert labels[902] == ["cc-by", "cc-by-nc-4.0"] and labels[903] == ["mit"] and labels[904] == ["gpl", "gpl-3.0"]
    assert labels[906] == [] and labels[907] == ["apache-2.0"] and labels[900] == ["reserved"]
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(r.base_labels) <= set(r.labels) for r in got)


def test_many_licences_in_one_file(spark):
    own = [t for t in licenses.TEMPLATES if len(t.words) > 12]
    short = [t for t in licenses.TEMPLATES if t.label in ("mpl-2.0", "unlicense", "cc0", "lgpl", "apache-2.0")]
    files = [own, short, list(licenses.TEMPLATES), [*licenses.TEMPLATES] * 20]
    texts = [(i, " filler words between ".join(t.text for t in f)) for i, f in enumerate(files)]
    # Files with other words, so that the index is of words that are rare.
    df = spark.createDataFrame([*texts, *[(100 + i, f"other words {i}") for i in range(40)]], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).where("doc_id < 100").collect()}
    assert {t.label for t in own} == {"mit", "bsd", "isc"} and len(short) == 5
    for i, f in enumerate(files):
        assert {t.label for t in f} <= set(got[i].labels), i
    assert got[0].score == pytest.approx(1.0)


def test_licences_run_no_python(documents, no_documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(no_documents).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "sys\nt<|em\\", "a<\\|b"), (2, None, "user", "first"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"),
    (None, 0, None, "x"), (3, 5, "assistant", "\n<|im_end|>\n0"), *[(4, i, "assistant" if i % 2 else "user", f"t{i} " * (i % 5)) for i in range(50)],
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "?") for r in TURNS], "conv_id long, turn long, role string, text string, span string").repartition(3)


def test_read_back(turns):
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns, window=4)).collect()}
    by = {}
    for c, t, role, text in sorted(TURNS, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said) and not r.rewrites
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.ChatMarkup().render(said))


def test_whole_conversations(turns):
    for r in chat.format_conversations(turns).where("conv_id in (1, 4)").collect():
        said = [(role or "", text or "") for c, _, role, text in TURNS if c == r.conv_id]
        assert r.formatted == chat.ChatMarkup().render(said)
        marked = [chat.ChatMarkup().plain(r.formatted[a:b]) for a, b in r.loss_spans]
        assert marked == [t for role, t in said if role == "assistant"]


def test_rewriting_templates_are_detected(turns):
    # Defined here so that it travels to the workers by value.
    class Forgetful(chat.ChatMarkup):
        """Drops earlier texts of the user once a third turn comes."""

        def render(self, turns):
            last = len(turns) - 2
            return chat.ChatMarkup.render(self, [(r, "" if k < last and r == "user" else t) for k, (r, t) in enumerate(turns)])

    rows = chat.format_turns(turns.where("conv_id = 1"), Forgetful()).collect()
    assert [r.rewrites for r in sorted(rows, key=lambda r: r.place)] == [False, False, True, False]


def test_templates_that_look_far_back(turns):
    class Late(chat.ChatMarkup):
        """Drops the text of turn 1 once turn 30 comes."""

        def render(self, turns):
            return chat.ChatMarkup.render(self, [(r, "" if k == 1 and len(turns) > 30 else t) for k, (r, t) in enumerate(turns)])

    class Numbered(chat.ChatMarkup):
        """Gives the number of each turn and needs the user to begin."""

        def render(self, turns):
            if turns and turns[0][0] != "user":
                raise ValueError("the user begins")
            return "".join(f"{k}:{chat.ChatMarkup.render(self, [t])}" for k, t in enumerate(turns))

    long, said = turns.where("conv_id = 4"), [(role, text) for c, _, role, text in TURNS if c == 4]
    for template, changed in ((Late(), [30]), (Numbered(), [])):
        rows = sorted(chat.format_turns(long, template).collect(), key=lambda r: r.place)
        assert [r.place for r in rows if r.rewrites] == changed
        text = ""
        for k, r in enumerate(rows):
            text = text[: r.start] + r.span
            assert text == template.render(said[: k + 1])
        (whole,) = chat.format_conversations(long, template).collect()
        assert whole.formatted == template.render(said) and whole.rewrites == bool(changed)
        marked = [template.plain(whole.formatted[a:b]) for a, b in whole.loss_spans]
        assert [m for m in marked if m] == [t for k, (r, t) in enumerate(said) if r == "assistant" and t and (k != 1 or not changed)]


def test_no_turns(turns):
    assert chat.read_back(chat.format_turns(turns.where("false"))).count() == 0
