import hashlib
import math
import re

import pytest
import regex
from pyspark.sql import functions as F

from ledgerflow.llm import pii
from tests.llm.helpers import awkward, documents, empty, prose


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - (9 if v > 4 else 0) for i, v in enumerate(map(int, d[::-1]))) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p, ok in KINDS for m in re.finditer(p, text or "") if ok(m.group())]


CASES = [
    "mail a.b+c@x-y.example.com, a@b.c_d@e.f and @x.y or z@w", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 4111  1111", "+1 (555) 010-9999 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
    "é中\U0001F600 x@y.zz 4111111111111111\n10.0.0.1", "a" * 3000 + "@b.c", "1" * 4000, "1 " * 3000, "+1 " * 2000,
    "a@b" + ".c" * 3000, "1.2.3.4" + "." * 50, "x@y.z@u.v", "99999999999999999999.1.1.1", "+1 4111 1111 1111 1111",
    "a@b.cd" * 200, "-1-2-3-4-5-6-7-8-9-0-1-2-3 4", "@." * 500, "++1 555 010 9999+1 555 010 9998",
]


def test_base_spans_match_brute_force(spark):
    rows = awkward() + [(200 + i, t) for i, t in enumerate(CASES)]
    out = pii.all_spans(documents(spark, rows)).select(
        F.col("_row.doc_id").alias("doc_id"), pii.written(pii.KINDS).alias("spans")).collect()
    expected = sorted((i or 0, ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base(t))) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in out) == expected


def corpus():
    """An address that stands beside one code name in different sentences, and filler."""
    rows = [(i, prose(i, 60)) for i in range(40)]
    for i in range(5):
        rows.append((100 + i, f"{prose(200 + i, 20)} talk to agent Zorbanium via z@corp.example.com about it. {prose(300 + i, 20)}"))
    rows += [(110, rows[-1][1])] * 6 + [(120, "Where is zorbanium now? " + prose(7, 20)), (121, "agent of the talk. " * 300)]
    return rows


BLANKLESS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
PIECE = regex.compile(rf"(?V1)[[\p{{L}}\p{{N}}]--[{BLANKLESS}]]+|[[\p{{L}}\p{{N}}]&&[{BLANKLESS}]]")


def words(text):
    return PIECE.findall(text.lower())


def brute_mentions(t, reach=8):
    """(entity, words around): the text between matches and the other matches are cut into words piece by piece."""
    out = []
    for k, pattern, ok in KINDS:
        found = list(re.finditer(pattern, t))
        at, pieces = 0, []
        for m in found:
            pieces += [words(t[at:m.start()]), words(m.group())]
            at = m.end()
        pieces.append(words(t[at:]))
        for i, m in enumerate(found):
            if ok(m.group()):
                left, right = sum(pieces[:2 * i + 1], []), sum(pieces[2 * i + 2:], [])
                value = m.group().lower() if k in ("email", "ip") else digits(m.group())
                out.append((f"{k}:{value}", tuple(left[-reach:] + right[:reach])))
    return out


def brute_terms(rows, reach=8, threshold=0.9, min_contexts=3):
    counts, pairs, contexts, entities, n = {}, {}, {}, {}, 0
    for _, t in rows:
        t = t or ""
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
            n += 1
        for e, near in brute_mentions(t, reach):
            entities[e] = entities.get(e, 0) + 1
            for w in near:
                pairs[e, w] = pairs.get((e, w), 0) + 1
                contexts.setdefault((e, w), set()).add(near)
    out = set()
    for (e, w), c in pairs.items():
        near = entities[e] * 2 * reach
        if len(contexts[e, w]) >= min_contexts and near < n:
            if math.log2(min(c, counts[w]) * n / (near * counts[w])) / -math.log2(near / n) >= threshold:
                out.add(w)
    return out


@pytest.mark.parametrize("inline", [5_000, 0])
def test_disclosing_terms(spark, inline):
    rows, threshold = corpus(), 0.6
    expected = brute_terms(rows, threshold=threshold)
    assert "zorbanium" in expected and "agent" not in expected
    found = pii.all_spans(documents(spark, rows), threshold=threshold, inline_terms=inline)
    out = found.select(F.col("_row.doc_id").alias("doc_id"), F.col("_term.value").alias("terms"), "_text").collect()
    for r in out:
        assert [t.lower() for t in r["terms"]] == [w for w in words(r["_text"]) if w in expected]
    assert any(r["doc_id"] == 120 and r["terms"] for r in out)


def test_short_names_and_far_words_disclose(spark):
    """Names of two letters, in scripts with and without blanks, and words far away in characters."""
    rows = corpus()
    for i in range(4):
        rows.append((500 + i, f"{prose(500 + i, 30)} 김수 {' ' * 300}k{i}@x.example.org {prose(600 + i, 30)}".replace(f"k{i}@", "k@")))
        rows.append((510 + i, f"{prose(510 + i, 30)}。我们和龘见面{'，' * 250}10.1.2.3。{prose(610 + i, 30)}"))
    expected = brute_terms(rows, threshold=0.6)
    assert {"김수", "龘"} <= expected
    out = pii.all_spans(documents(spark, rows), threshold=0.6).select(F.col("_term.value").alias("terms"), "_text").collect()
    for r in out:
        assert [t.lower() for t in r["terms"]] == [w for w in words(r["_text"]) if w in expected]


def test_contexts_match_brute_force(spark):
    rows = awkward() + [(200 + i, t) for i, t in enumerate(CASES)] + corpus() + [(400, "1.2.3.4 5.6.7.8,9.9.9.9 a b +1 555 010 9999 c " * 40)]
    packed = documents(spark, rows).select(F.coalesce("text", F.lit("")).alias("_text"))
    got = pii.mentions(pii.base_spans(packed)).collect()
    expected = [m for _, t in rows for m in brute_mentions(t or "")]
    assert sorted((r["entity"], tuple(r["words"])) for r in got) == sorted(expected)


def test_many_spans_in_one_text(spark):
    text = "".join(f"{'x' * (i % 7)} 10.{i % 256}.{i // 256}.1 a{i % 50}@b.cd" + " é" * (i % 3) for i in range(8_000))
    row = pii.all_spans(documents(spark, [(1, text)]), threshold=2.0).select(
        pii.written(pii.KINDS).alias("spans"), pii.sanitized(pii.all_spans(documents(spark, [(1, text)]), threshold=2.0)).alias("clean")).first()
    assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base(text))
    out, at = [], 0
    for a, b, label in sorted((a, b, f"[{k.upper()}]") for k, a, b, _ in base(text)):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    assert row["clean"] == "".join(out) + text[at:]


def test_sanitised_texts(spark):
    rows = corpus() + [(300, "Call 4111 1111 1111 1111 or a@b.cd, 1.2.3.4."), (301, None), (302, "")]
    out = {r["doc_id"]: r for r in pii.sanitize(documents(spark, rows), threshold=0.6).collect()}
    assert out[301]["text"] is None and out[302]["text"] == "" and out[0]["text"] == prose(0, 60)
    assert out[300]["text"] == "Call [CARD] or [EMAIL], [IP]."
    assert "[EMAIL]" in out[100]["text"] and "[TERM]" in out[100]["text"] and "orbanium" not in out[100]["text"]
    assert out[100]["n_chars"] == len(out[100]["text"]) and out[100]["_text"] == "own _text" and len(out) == len(dict(rows))


def test_overlapping_spans_are_one(spark):
    text = "a +1.2.3.4 55555 end"
    assert len(base(text)) == 2
    assert pii.sanitize(documents(spark, [(1, text)])).first()["text"] == "a [PHONE] end"


def test_empty_table(spark):
    assert pii.sanitize(empty(spark)).count() == 0 and pii.all_spans(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    pii.all_spans(documents(spark)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
