"""Literal inputs and expected texts of the cleaning functions."""

import pytest
from pyspark.sql import functions as F

from postloom.functions import address, dates, reply_text, text
from postloom.operators import messages


def apply(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("s"))).collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_strip_html(spark):
    check(spark, text.strip_html, [
        ("", ""),
        ("plain, nothing else", "plain, nothing else"),
        ("Good <b>day</b>", "Good day"),
        ('<a href="https://x.example">here</a>', "here"),
        ("line1<br>line2<br/>line3", "line1\nline2\nline3"),
        ('text<img src="p.png" alt="a">text', "texttext"),
        ("<section><p>Two <i>nested</i> tags</p></section>", "Two nested tags"),
        ("<p>First</p><p>Second</p>", "First\nSecond"),
        ("<ul><li>One</li><li>Two</li></ul>", "One\nTwo"),
        ("a<!-- <div>hidden</div> -->b", "ab"),
        ("a<!--\nmany\nlines\n-->b", "ab"),
        ("a<!-- never closed <p>x</p>", "a"),
        ("a<script>alert('x')</script>b", "ab"),
        ("a<SCRIPT type='t'>if (a<b) {}</SCRIPT>b", "ab"),
        ("a<script>open forever", "a"),
        ("a<scripted>b", "ab"),
        ("a<style>p { color: red }</style>b", "ab"),
        ("a < b > c", "a < b > c"),
        ("kept <cut off here", "kept"),
        ("a<b>c</b>d>e", "acd>e"),
        ("a<b>c</b", "ac"),
        ("ends with <", "ends with <"),
        ('<a title="a > b">link</a>', "link"),
        ("<a title='a > b'>link</a>", "link"),
        ('<!DOCTYPE html PUBLIC "-//X//DTD > Y">content', "content"),
        ("left<![CDATA[1 <2> 3]]>right", "left1 <2> 3right"),
        ("x<![CDATA[open>y", "xy"),
        ("x<![CDATA[open", "x![CDATA[open"),
        ("x<![cdata[low]]>y", "xy"),
        ("<P>paragraph</P> with <B>bold</B>", "paragraph\nwith bold"),
        ("t<my-part a='v'>c</my-part>m", "tcm"),
        ("<p>a</p>\n\n\n<p>b</p>", "a\nb"),
        ("  <p> hello　</p>  ", "hello"),
    ])


def test_long_markup_neither_overflows_nor_slows(spark):
    long_tag = "<p " + "a='x' " * 40000 + ">end"
    many_open = "<" * 50000 + "x"
    quotes = "<a " + "'" * 60001 + ">"
    check(spark, text.strip_html, [(long_tag, "end"), (many_open, many_open[:-2]), (quotes, "")])


def test_entities(spark):
    check(spark, text.decode_entities, [
        ("", ""), ("no entity", "no entity"), ("AT&amp;T", "AT&T"), ("&lt;&gt;&amp;", "<>&"),
        ("a&nbsp;b", "a b"), ("&Prime;&prime;", "″′"), ("&AMP;", "&AMP;"),
        ("&#65;&#x41;&#X1F600;", "AA😀"), ("&#0;", "&#0;"), ("&#xD800;", "&#xD800;"),
        ("&#x110000;", "&#x110000;"), ("&#;", "&#;"), ("&#x;", "&#x;"), ("&unknown; x", "&unknown; x"),
        ("&amp;lt;", "&lt;"), ("a & b &amp; c", "a & b &amp; c"), ("AT&T", "AT&T"), ("x &", "x &"),
        ("&#4294967361;", "A"), ("&#x1000000041;", "A"), ("&" * 50000, "&" * 50000),
    ])


def test_control_characters(spark):
    check(spark, text.strip_control_chars, [
        ("a\x00b\x1bc", "abc"), ("t\ta\nb\rc", "t\ta\nb\rc"), ("x\x7f\x85\x9fy\xa0z", "xy\xa0z")])
    check(spark, text.sanitize_body, [("  a\x01b\x7f\n", "ab\x7f")])


def test_headers_and_addresses(spark):
    check(spark, text.sanitize_header, [
        ("", ""), (" Up <i>to</i> 9 % ", "Up to 9 %"), ("AT&amp;T &lt;price&gt;", "AT&T <price>"),
        ("a\x00b", "ab"), ("<li>one</li><li>two</li>", "one\ntwo")])
    check(spark, text.sanitize_address_field, [
        ("Bob <bob@example.com>", "Bob <bob@example.com>"), ("AT&amp;T <a@b.com>", "AT&T <a@b.com>"),
        ("Bob\x01 <b@c.de> ", "Bob <b@c.de>")])


@pytest.mark.parametrize("given, sender, domain", [
    ("user@Example.COM", "user@Example.COM", "example.com"),
    ("Name <user@example.com>", "user@example.com", "example.com"),
    ('"Last, First" <a@b.org>', "a@b.org", "b.org"),
    ("Open <a@b.org", "a@b.org", "b.org"),
    ("x > y <a@b.org", "x > y <a@b.org", "b.org"),
    ("A <one@x.org> B < two@y.org >", "two@y.org", "y.org"),
    ("a <b@c> d>", "b@c> d", "c> d"),
    ("odd@name@host.example", "odd@name@host.example", "host.example"),
    ("@host", "", ""), ("user@", "", ""), ("nobody", "", ""), ("", "", ""), ("  ", "", ""),
    ("Name <>", "", ""),
])
def test_senders(spark, given, sender, domain):
    df = spark.createDataFrame([(given,)], "from_addr string")
    row = messages.with_sender(df).first()
    assert (row.sender, row.domain) == (sender, domain)
    listed = df.select(address.senders(F.col("from_addr")).alias("s")).first().s
    assert listed == ([sender] if sender else [])


def test_truncation(spark):
    check(spark, lambda c: text.truncate(c, 5), [("hello", "hello"), ("hello!", "hell…"), ("日本語テスト", "日本語テ…")])
    check(spark, lambda c: text.truncate(c, 0), [("x", "")])
    check(spark, lambda c: text.excerpt(c, 5), [("hello!", "hello…")])
    check(spark, lambda c: text.excerpt(c, 0), [("hello!", "hello!")])
    check(spark, text.clip_error, [("e" * 80, "e" * 80), ("e" * 81, "e" * 77 + "...")])


def test_redaction_is_literal(spark):
    check(spark, lambda c: text.redact(c, ["k.y", "k.y+long", "\\Ex", ""]), [
        ("a k.y b kxy", "a [REDACTED] b kxy"), ("k.y+long", "[REDACTED]"), ("\\Ex", "[REDACTED]")])


def test_reply_text(spark):
    check(spark, reply_text.strip_fences, [
        ("```json\n{}\n```", "{}"), ("```\n{}\n``` bye", "{}"), (" {} ", "{}"), ("{}\n```", "{}")])
    check(spark, reply_text.json_part, [
        ("so: {\"a\": {}} bye", "{\"a\": {}}"), ("} {", "} {"), ("none", "none"), ("{", "{")])


def test_ledger_times(spark):
    def parse(c):
        return dates.parse_ledger_time(c).cast("string")

    check(spark, parse, [
        ("2026-07-14T10:00:00Z", "2026-07-14 10:00:00"),
        ("2026-07-14T10:00:00.5Z", "2026-07-14 10:00:00.5"),
        ("2026-07-14T12:00:00.123456+02:00", "2026-07-14 10:00:00.123456"),
        ("2026-07-14 12:00:00.123456 +0200 +02", "2026-07-14 10:00:00.123456"),
        ("2026-07-14 10:00:00.25 +0000 UTC m=+0.013", "2026-07-14 10:00:00.25"),
        ("2026-07-14 10:00:00 +0000", "2026-07-14 10:00:00"),
        ("2026-07-14 10:00:00", "2026-07-14 10:00:00"),
        ("soon", None),
    ])
    check(spark, lambda c: dates.ledger_time(c.cast("timestamp_ntz")), [
        ("2026-07-14 10:00:00", "2026-07-14T10:00:00Z"),
        ("2026-07-14 10:00:00.120", "2026-07-14T10:00:00.12Z")])


def test_charset(spark):
    df = spark.createDataFrame([(bytearray(b"H\xe9ll\xf2"),)], "b binary")
    assert df.select(text.convert_charset(F.col("b"), "ISO-8859-1")).first()[0] == "Héllò"


def test_confidence_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.995,), (0.005,), (1.0,)], "c double")
    got = [r[0] for r in df.select(messages.confidence_percent(F.col("c"))).collect()]
    assert got == [f"{c * 100:.0f}%" for c in (0.125, 0.135, 0.995, 0.005, 1.0)]
