"""Paragraphs of Markdown against cases worked out by hand, and whole tables by a loop."""

import pytest
from pyspark.sql import functions as F

from corpuslathe.sources import markdown

CASES = [
    ("", []), (" \n\t\n", []), ("one\ntwo\n\nthree", ["one\ntwo", "three"]), ("one\r\ntwo\rthree", ["one\ntwo\nthree"]), ("# Head\ntext\n## Sub\nmore", ["text", "more"]), ("#no head", ["#no head"]),
    ("Title\n=====\ntext\n\nSub\n---\nmore", ["text", "more"]), ("a\n\n---\nb", ["a", "b"]), ("* * *\na", ["a"]), ("a\n***\nb", ["a", "b"]),
    ("```\ncode\n\nmore\n```\ntext", ["text"]), ("~~~~\ncode\n~~~\nstill\n~~~~~\ntext", ["text"]), ("```\nnever closed", []), ("a\n```\nc\n```\nb", ["a", "b"]), ("``` a`b", ["``` a`b"]),
    ("    code\ntext\n    goes on", ["text\ngoes on"]), ("\tcode", []), ("| a | b |\n|---|---|\ntext", ["text"]), ("<div>\ntext", ["text"]),
    ("> quoted\n> on", ["quoted\non"]), ("> quoted\nlazy", ["quoted\nlazy"]), ("> quoted\n\nnot", ["quoted", "not"]), ("> a\n> > b\n> > c\n> d", ["a", "b\nc\nd"]), ("> > > deep\nlazy\n> on", ["deep\nlazy\non"]),
    ("> a\n# Head\nb", ["a", "b"]), ("> ```\n> code\ntext", ["text"]), ("> ```\n> code\n> ```\n> text", ["text"]), (">     code\n> text", ["text"]), (">a\n>b", ["a\nb"]),
    ("- one\n- two", ["one", "two"]), ("- one\n  on\n\n  second\n- two", ["one\non", "second", "two"]), ("- one\nlazy", ["one\nlazy"]), ("- one\n\nout", ["one", "out"]), ("1. one\n2. two\n   on", ["one", "two\non"]),
    ("- a\n  - b\n    - c\n      on\n  - d\n- e", ["a", "b", "c\non", "d", "e"]), ("- ```\n  code\n  ```\n  text", ["text"]), ("- ```\n  code\ntext", ["text"]), ("-     code\n\n  text", ["text"]),
    ("- > quoted\n  > on\n  lazy", ["quoted\non\nlazy"]), ("> - item\n>   on\n> - two\nlazy", ["item\non", "two\nlazy"]), ("> 1. a\n>\n>    b\n>\n> c", ["a", "b", "c"]),
    ("text\n- item", ["text", "item"]), ("text\n2. no item", ["text\n2. no item"]), ("text\n1. item", ["text", "item"]), ("text\n-\nmore", ["more"]), ("text\n*\nmore", ["text\n*\nmore"]), ("-\n  a", ["a"]), ("10) ten\n    on", ["ten\non"]),
    ("- - - a", ["a"]), ("- - -", []), ("-no", ["-no"]), ("+ a\n\n\n  b", ["a", "b"]), ("- a\n\n    code? no\n\n      code", ["a", "code? no"]), ("> a\n---\nb", ["a", "b"]), ("> a\n===", ["a\n==="]),
]


def test_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None)], "i int, t string").select("i", markdown.paragraphs(F.col("t")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert got.pop(-1) is None
    assert {CASES[i][0]: p for i, p in got.items()} == dict(CASES)


@pytest.mark.parametrize("table, column", [("documents", "text"), ("conversations", "text")])
def test_tables_by_a_loop(spark, sf, table, column):
    """Plain prose has no containers: its paragraphs are what blank lines part."""
    texts = [r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(column).distinct().collect() if r[0] is not None]
    plain = [t for t in texts if not any(x.lstrip()[:1] in tuple("#>-+*|<`~=_") or x.lstrip()[:1].isdigit() or x.startswith(("    ", "\t")) for x in t.split("\n"))]
    assert len(plain) > 0.5 * len(texts)

    def loop(text):
        out, para = [], []
        for line in [*text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n"), ""]:
            if line.strip(" "):
                para.append(line.strip(" "))
            elif para:
                out.append("\n".join(para))
                para = []
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, t string").select("i", markdown.paragraphs(F.col("t")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {i: loop(t) for i, t in enumerate(plain)}
