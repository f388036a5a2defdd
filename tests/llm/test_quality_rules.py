import re
from collections import Counter

from tessera.llm import quality_rules as Q

from .helpers import ODD, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup, lost = set(), 0, 0
    for line in t.split("\n"):
        lw = WORD.findall(line)
        if not lw:
            continue
        dup += line in seen
        seen.add(line)
        end = lw[-1]
        failed = len(lw) >= Q.TITLE_WORDS and end[-1] not in ".!?:;\"')]…”»"
        n = len(re.findall(r"[#*$%&|<>]", line))
        failed |= n >= Q.SYMBOLS and 10 * n >= 3 * len(lw)
        p = line.count("|") + line.count(">")
        failed |= p >= Q.SEPARATORS and 4 * p >= len(lw)
        failed |= line.count("!") >= Q.SHOUTS and 2 * line.count("!") >= len(lw)
        failed |= any(x in line.lower() for x in Q.BOILERPLATE)
        lost += len(lw) * bool(failed)
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), base, not base and lost <= Q.MAX_LOST * len(w), lost


def texts():
    p = prose(40, 3, 250)
    junk = ["a | b | c | d\n" * 9, "Read more\n" * 60, p[0] + "\n" + p[0], "Same line here now.\n" * 30, "WOW!!! YES!!! NO!!!\n" + p[1],
        "### $$$ %%% " * 40 + p[2], "no end\n" * 70, p[3] + ".\n\n", "Privacy Policy | Terms of use\n" + p[4] + "."]
    return p + junk


def test_against_brute_force(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(texts())]
    got = Counter(tuple(r) for r in Q.judge(table(spark, rows).repartition(2)).collect())
    assert got == Counter((k, *brute(t)) for k, t in rows)


def test_clean_removes_failed_lines_only(spark):
    body = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(12))
    rows = [(1, "Home | News | Sport | More\n" + body), (2, body), (3, "a | b | c\n" * 40), (4, None)]
    d = table(spark, rows)
    got = {r.doc_id: r.text for r in Q.clean(d).collect()}
    assert got == {1: body, 2: body}
    assert Q.clean(d).columns == d.columns
    assert Q.judge(d.limit(0)).count() == Q.clean(d.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"Line {i} has words of its own, number {i * 7919 % 100003}." for i in range(40_000)) + "\nno end here at all\n" * 3
    rows = [(1, text), (2, "z" * 2_000_000)]
    assert Counter(tuple(r) for r in Q.judge(table(spark, rows)).collect()) == Counter((k, *brute(t)) for k, t in rows)


def test_clean_takes_columns_of_any_names(spark):
    body = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(12))
    d = table(spark, [(1, body), (1, body)]).selectExpr("text", "doc_id", "1 AS `a.b`", "map('x', 1) AS m")
    out = Q.clean(d)
    assert out.dtypes == d.dtypes and [r["a.b"] for r in out.collect()] == [1, 1]
