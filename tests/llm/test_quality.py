import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import quality_classifier as qc
from ledgerflow.llm import quality_rules as qr
from tests.llm.helpers import WORD, awkward, by_id, documents, empty, prose


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_measures_match_brute_force(spark):
    got = qr.clean_lines(documents(spark)).collect()
    rows = awkward()
    assert len(got) == len(rows)
    expected = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] for r in got if r["base_failed"])


@pytest.mark.parametrize("width", [40, 199, 200, 201, 400])
def test_no_width_decides_by_itself(width):
    """An unmarked line before a marked one that goes on, or that does not, at any width."""
    unmarked = ("word " * 100)[:width - 1] + "x"
    rules = qr.Rules(unpunctuated_words=5)
    assert qr.judge(unmarked + "\nand so it went on.", rules, re.compile("(?!)"))[8] == 0
    assert qr.judge(unmarked + "\nA sentence follows.", rules, re.compile("(?!)"))[8] == 1


def test_a_wrapped_sentence_of_many_lines_is_one():
    words = ["all rights reserved"] + ["and other small words"] * 60
    lines = textwrap.fill(" ".join(words), 30).split("\n")
    found = qr.wrapped(lines)
    assert len(lines) > 40 and set(found.sentence) == {0} == set(found.paragraph) and found.whole(3) == " ".join(lines)
    apart = qr.wrapped(["Home", "About us and others", "X", "", "y"])
    assert apart.paragraph == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("line, rule", [
    ("Home | News | About us | Contact", "navigation"), ("Skip to content", "navigation"),
    ("word### other$$$ third%%% fourth&&&", "punctuation"), ("OF!! THE!! AND!! WITH!!", "punctuation"),
    ("word " * 20, "punctuation"), ("All rights reserved.", "boilerplate"), ("A plain sentence, with marks.", None),
    ("Write to a.b@mail.example.com or call +1 (555) 010-9999.", None), ("Des.", None)])
def test_line_rules(line, rule):
    import re
    rules = qr.Rules()
    phrases = re.compile("|".join(map(re.escape, rules.stock_phrases)), re.I)
    assert qr.line_failure(line, line.split(), False, rules, phrases) == rule


def test_failing_lines_go_and_lossy_documents_are_rejected(spark):
    good = prose(1, 50)
    rows = [(1, good), (2, good + "\nHome | News | About\nAll rights reserved."), (3, good[:60] + "\n" + "A | B | C | D\n" * 40),
            (4, good + "\n" + good)]
    out = {r["doc_id"]: r for r in qr.keep_good(documents(spark, rows)).collect()}
    assert out[1]["text"] == good and out[2]["text"] == good and 3 not in out and 4 not in out
    assert out[2]["n_chars"] == len(good) and out[1]["score"] == "own score" and out[1]["a.b"] == "own a.b"
    assert set(out[1].asDict()) == set(documents(spark, []).columns)


def test_empty_tables(spark):
    assert qr.clean_lines(empty(spark)).count() == 0 and qr.keep_good(empty(spark)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert qc.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in qc.classify(documents(spark), labels).collect()} == {0.5}


def junk(seed):
    return " ".join(w + "$$$" for w in prose(seed, 80).split())


def test_classifier_separates_held_out_texts(spark):
    rows = [(i, prose(i, 60 + i % 40)) for i in range(300)] + [(1000 + i, junk(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows] * 2 + [(None, 1), (5, None), (7, 3)],
                                   "doc_id long, label int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = qc.classify(documents(spark, rows), labels.where(~held))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in out.collect()}
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and len(test) > 40
    assert np.mean([got[i][1] == int(i < 1000) for i in test]) > 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())


def test_scores_of_awkward_texts_are_defined(spark):
    rows = [(100 + i, prose(i, 50)) for i in range(60)] + [(300 + i, junk(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in rows], "doc_id long, label int")
    out = qc.classify(documents(spark, rows + awkward()), labels).collect()
    assert len(out) == len(rows) + len(awkward()) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out)


def test_discriminant_matches_the_closed_form():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + k for k in (0, 1)]
    m = qc.fit(np.array([200.0, 200.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.2, 0.1)
    point = rng.normal(size=(5, 4))
    cov = [a.T @ a / 200 - np.outer(a.mean(0), a.mean(0)) for a in x]
    within = (cov[0] + cov[1]) / 2
    dens = []
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * within
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-6 * np.eye(4)
        d = point - x[k].mean(0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.log_odds(point), dens[1] - dens[0])


@pytest.mark.parametrize("width", [60, 72, 80, 100, 132])
def test_wrapped_prose_is_kept_unchanged(spark, width):
    def sentence(seed):
        return prose(seed, 45).replace(".", "").capitalize() + "."

    texts = ["\n\n".join(textwrap.fill(" ".join(sentence(100 * i + j) for j in range(4)), width) for i in range(k, k + 3))
             for k in range(6)]
    assert any(len(line.split()) >= 12 and "." not in line for t in texts for line in t.split("\n"))
    out = {r["doc_id"]: r["text"] for r in qr.keep_good(documents(spark, list(enumerate(texts)))).collect()}
    assert out == dict(enumerate(texts))


@pytest.mark.parametrize("text, failing", [
    ("یہ ایک جملہ ہے " * 4 + "۔", 0), ("ภาษาไทยเขียน ประโยคโดยไม่มี เครื่องหมาย " * 6, 0),
    ("word " * 20, 1), ("word " * 20 + "\n\nA sentence stands apart.", 1), ("word " * 60 + "\nA sentence follows.", 1)])
def test_marks_of_other_scripts_and_of_paragraphs(text, failing):
    rules = qr.Rules()
    assert qr.judge(text, rules, re.compile("(?!)"))[8] == failing


@pytest.mark.parametrize("width", [40, 199, 200, 201, 400])
def test_no_width_decides_by_itself(width):
    """An unmarked line before a marked one that goes on, or that does not, at any width."""
    unmarked = ("word " * 100)[:width - 1] + "x"
    rules = qr.Rules(unpunctuated_words=5)
    assert qr.judge(unmarked + "\nand so it went on.", rules, re.compile("(?!)"))[8] == 0
    assert qr.judge(unmarked + "\nA sentence follows.", rules, re.compile("(?!)"))[8] == 1


def test_a_wrapped_sentence_of_many_lines_is_one():
    words = ["all rights reserved"] + ["and other small words"] * 60
    lines = textwrap.fill(" ".join(words), 30).split("\n")
    found = qr.wrapped(lines)
    assert len(lines) > 40 and set(found.sentence) == {0} == set(found.paragraph) and found.whole(3) == " ".join(lines)
    apart = qr.wrapped(["Home", "About us and others", "X", "", "y"])
    assert apart.paragraph == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("line, rule", [
    (prose(1, 60) + " A mill powered by water, read more below. " + prose(2, 60), None), ("Empowered by all, they won.", None),
    ("Click here to read more", "boilerplate"), ("© 2020 The Company. All rights reserved.", "boilerplate")])
def test_a_phrase_fails_a_line_by_its_share_of_words(line, rule):
    rules = qr.Rules()
    assert qr.line_failure(line, line.split(), False, rules, qr.phrase_pattern(rules)) == rule


def test_prose_with_a_phrase_is_kept(spark):
    one_line = prose(3, 40) + " It was powered by steam. " + prose(4, 40)
    wrapped = prose(5, 30) + "\n\nThe old mill in the valley below the town was at first only\npowered by water."
    out = {r["doc_id"]: r["text"] for r in qr.keep_good(documents(spark, [(1, one_line), (2, wrapped)])).collect()}
    assert out == {1: one_line, 2: wrapped}
