"""Finders of protected content: what each kind takes and leaves, and plain rules on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sigloom.operators import scan, spans

CASES = {
    "URL": (
        ["https://a.org/x_(y)", "http://host/p?q=1#z", "WWW.site.net/a", "example.com", "sub.example.co.uk:8080/p", "xn--abc.xn--p1ai", "a.io?x=1"],
        ["http:// x", "xhttp://a", "a.b1", "file.x", "version 1.2", "a..com", "-a.com"],
    ),
    "EMAIL": (["a@b.cc", "first.last+tag@mail-1.example.org", "x!y@a.b"], ["a@b", "@a.bc", "a@-b.cc", "a@b.cc-", "a@b..cc"]),
    "IPV4": (["1.2.3.4", "255.255.255.255"], ["1.2.3", "256.1.1.1", "1.2.3.4.5", "01.2.3.4"]),
    "IPV6": (["::1", "fe80::1%eth0", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8"], ["1:2", "12:30:45", "g::1x", "1:2:3:4:5:6:7:8:9"]),
    "DATE": (
        ["2024-02-29", "31/12/2024", "12/31/2024", "2024/1/5", "3/4/21", "Feb 29, 2024", "1 sept 2020", "March  3 1999"],
        ["2023-02-29", "31/02/2024", "Feb 31, 2024", "2024-2-1", "13/13/2020", "1 foo 2020", "Feb29 2024"],
    ),
    "NUMBER": (["1", "-2.5", "+3", ".5", "1,234,567.8", "1e-5", "12345"], ["a1", "1a", "x.5", "_7"]),
    "PERCENTAGE": (["5%", "-2.5 %", "1,000%"], ["%", "5%x", "a5%"]),
    "CURRENCY": (["$5", "€ 1,000.50", "-$3", "USD 5", "5 eur", "1.5JPY", "+ £2"], ["5", "usd", "a$b", "5 eurx"]),
    "CLI_FLAG": (["-v", "--dry-run", "--name=value,x", "-x=1"], ["---x", "a-b", "- x", "-1"]),
    "CITATION": (["[1]", "[1, 2-5]", "(Smith, 2020)", "(Smith and Jones, 1999a)", "(Doe et al. Roe, 2001)", "(O'Hara & Li-Wu, 2010)"], ["[a]", "[ 1]", "(smith, 2020)", "(Smith 2020)", "(Smith, 20201)", "(S, 2020)"]),
    "QUOTATION": (['"a b"', "“x”", "'two words'", "‘ab’"], ["it's", "'x'", "‘a’"]),
    "MARKDOWN_DESTINATION": (["[a](b)"], ["](b)", r"[a\](b)"]),
    "MATH": (["$x+y$", "$$a\nb$$", r"\(x\)", r"\[y\]"], ["$5", "$5 and $6"]),
    "POSIX_PATH": (["/usr/bin", "~/x.y", "./a/b", "../c"], ["a/b", "x:/y", "/"]),
    "WINDOWS_PATH": ([r"C:\a\b.txt", r"\\host\share\x"], [r"\a", r"1C:\a b"[3:], "C:"]),
    "CODE": (["`x`", "``a ` b``", "```\nx\n```", "~~~\nopen"], ["x", "~~"]),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_kinds(kind):
    yes, no = CASES[kind]
    for value in yes:
        text = value if kind == "CODE" else f"say {value} ."
        found = [text[s:e] for s, e, _ in scan.find(text, kinds=(kind,))]
        want = "b" if kind == "MARKDOWN_DESTINATION" else value
        assert set(found) == {want}, (value, found)
    for value in no:
        text = f"say {value} ."
        assert not [text[s:e] for s, e, _ in scan.find(text, kinds=(kind,)) if text[s:e].strip() == value.strip() or kind in ("IPV4", "DATE", "CITATION")], value


def test_ends_and_brackets():
    of = lambda t, k: [t[s:e] for s, e, _ in scan.find(t, kinds=(k,))]
    assert of("(see https://en.org/A_(b)).", "URL") == ["https://en.org/A_(b)"]
    assert of("at https://a.org/x, and b.com!", "URL") == ["https://a.org/x", "b.com"]
    assert of("1,234,5678 3.14abc 5.", "NUMBER") == ["1,234", "5678", "3", "5"]
    assert of('open "to the end\nnext', "QUOTATION") == ['"to the end']
    assert of("a `b c\n\nd`", "CODE") == ["`b c", "`"]
    assert of("cp /a b/c.txt now; x", "POSIX_PATH")[-1] == "/a b/c.txt"
    assert of("C:\\My Files\\a b.doc is", "WINDOWS_PATH")[-1] == "C:\\My Files\\a b.doc"
    assert scan.find("ab foo_x foo", ("foo",)) == [(9, 12, "IDENTIFIER")]


def test_random_texts_by_plain_rules():
    """Whole chunks of random characters against rules stated another way."""
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("0123.,-+a %$/@:eE") for _ in range(rng.randrange(14)))
        found = scan.find(t)
        by = {k: [(s, e) for s, e, kind in found if kind == k] for k in scan.FINDERS}
        assert all(0 <= s < e <= len(t) for s, e, _ in found)
        for k in ("NUMBER", "DATE", "CURRENCY", "IPV4", "EMAIL"):
            assert all(a[1] <= b[0] for a, b in zip(by[k], by[k][1:])), (t, k)
        parts = [(m.start(), m.end()) for m in re.finditer(r"(?<![\d.])\d+(\.\d+){3}(?![\d.])", t) if all(str(int(p)) == p and int(p) < 256 for p in m[0].split("."))]
        assert by["IPV4"] == parts, t
        for s, e in by["NUMBER"]:
            assert float(t[s:e].replace(",", "")) is not None and not (t[s - 1 : s] or " ")[-1].isalnum() and not (t[e : e + 1] or " ").isalnum()
        assert all(any(c.isdigit() for c in t[s:e]) for s, e in by["PERCENTAGE"] + by["CURRENCY"])


def test_long_texts_take_linear_time():
    for piece in ("[", "(", '"a', "$$", "`", "'ab ", "1,", "1.", "a@", "a.", "-", "~~~", "\\("):
        scan.find(piece * 20_000)


def test_marked_ranges_and_identifiers(spark):
    df = spark.createDataFrame([(1, "call foo now"), (2, None), (3, "é 5%")], "doc_id long, text string")
    marked = spark.createDataFrame([(1, 0, 4)], "doc_id long, start int, end int")
    got = spans.raw_spans(df, identifiers=("foo",), marked=marked).orderBy("doc_id", "start", "kind").collect()
    assert [tuple(r) for r in got] == [(1, "USER_MARKED_ENTITY", 0, 4, "call"), (1, "IDENTIFIER", 5, 8, "foo"), (3, "NUMBER", 2, 3, "5"), (3, "PERCENTAGE", 2, 4, "5%")]
    kept = spans.protected(spans.raw_spans(df)).select("start", F.concat_ws("+", "kinds").alias("k")).collect()
    assert [tuple(r) for r in kept] == [(2, "NUMBER+PERCENTAGE")]


def test_candidates_and_their_order(spark):
    text = "The Version of VERSION 2, versioN and version at http://version.org"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rules = spark.createDataFrame([("v", "(?i)version"), ("n", "[0-9]")], "rule string, pattern string")
    raw = spans.protected(spans.raw_spans(df, kinds=("URL",)))
    told = spans.candidates(spans.rule_matches(df, rules), raw, precondition=F.col("rule") == "v").orderBy("start").collect()
    assert [(r.value, r.reason, r.place) for r in told] == [
        ("Version", None, 0), ("VERSION", "ALL_CAPS", None), ("2", "PRECONDITION", None), ("versioN", "UNSUPPORTED_CASE", None), ("version", None, 1), ("version", "PROTECTED_OVERLAP", None),
    ]
