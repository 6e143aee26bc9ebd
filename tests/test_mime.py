"""Raw messages in, body and attachments out."""

import base64
import quopri
import random

import pytest

from postloom.sources import mime


def read(spark, raw):
    data = raw if isinstance(raw, bytes) else raw.replace("\n", "\r\n").encode()
    df = spark.createDataFrame([(1, bytearray(data))], "uid bigint, raw binary")
    row = mime.bodies_and_attachments(mime.message_leaves(df)).first()
    return row.body, [tuple(a) for a in row.attachments]


def part(kind, body, *more):
    return "\n".join([f"Content-Type: {kind}", *more, "", body, ""])


def multi(kind, *parts, boundary="=_b"):
    inner = "".join(f"--{boundary}\n{p}\n" for p in parts)
    return f'Content-Type: multipart/{kind}; boundary="{boundary}"\n\n{inner}--{boundary}--\n'


PLAIN = part("text/plain; charset=utf-8", "Plain text.")
HTML = part("text/html; charset=utf-8", "<h1>Title</h1><p>Some <b>bold</b> &amp; &lt;text&gt;.</p>")


@pytest.mark.parametrize("raw, body", [
    (PLAIN, "Plain text."),
    (HTML, "Title\nSome bold & <text>."),
    (multi("alternative", PLAIN, HTML), "Plain text."),
    (multi("alternative", HTML, PLAIN), "Title\nSome bold & <text>."),
    (multi("alternative", "Content-Type: text/plain\n", HTML), "Title\nSome bold & <text>."),
    (part("text/plain; charset=utf-8", ""), ""),
    (part("text/plain; charset=utf-8", "Hello =E2=9C=93 world", "Content-Transfer-Encoding: quoted-printable"),
     "Hello ✓ world"),
    ("Subject: no type\n\nstill text", "still text"),
    (part("application/pdf", "JVBERi0="), ""),
    (multi("mixed", part("text/plain; charset=no-such-charset", "x"), HTML), "Title\nSome bold & <text>."),
])
def test_bodies(spark, raw, body):
    assert read(spark, raw) == (body, [])


def test_charset(spark):
    raw = b"Content-Type: text/plain; charset=iso-8859-1\r\n\r\nH\xe9llo W\xf6rld"
    assert read(spark, raw) == ("Héllo Wörld", [])


def test_attachments(spark):
    pdf = part('application/pdf; name="r.pdf"', "JVBERi0xLjQK",
               'Content-Disposition: attachment; filename="r.pdf"', "Content-Transfer-Encoding: base64")
    named = part('application/octet-stream; name="data.bin"', "bytes")
    unnamed = part("image/png", "x", "Content-Disposition: attachment")
    inline = part("image/png", "x", "Content-Disposition: inline")
    csv = part('text/csv; name="d.csv"', "a,b", 'Content-Disposition: attachment; filename="d.csv"')
    inner = multi("alternative", PLAIN, HTML, boundary="=_inner")
    body, found = read(spark, multi("mixed", csv, inner, pdf, named, unnamed, inline))
    assert body == "Plain text."
    assert [(f, m) for f, m, _ in found] == [
        ("d.csv", "text/csv"), ("r.pdf", "application/pdf"), ("data.bin", "application/octet-stream"),
        ("", "image/png")]
    assert found[1][2] == 9


def test_a_nested_mail_is_an_attachment(spark):
    inner = "Content-Type: message/rfc822\n\nSubject: inner\nContent-Type: text/plain\n\nINNER BODY\n"
    body, found = read(spark, multi("mixed", inner, PLAIN))
    assert body == "Plain text." and [(f, m) for f, m, _ in found] == [("", "message/rfc822")]


def test_encoded_file_name(spark):
    pdf = part("application/pdf", "x", "Content-Disposition: attachment; filename=\"=?utf-8?b?csOpc3Vtw6kucGRm?=\"")
    assert read(spark, multi("mixed", PLAIN, pdf))[1][0][0] == "résumé.pdf"


def test_no_row_ends_the_job(spark):
    """Null and broken messages keep their row, as do two messages with one key."""
    bad = [None, b"", b"Content-Type: text/plain; charset=idna\r\n\r\n\xff\xfe",
           b"Content-Type: text/plain; charset=\"a\x00b\"\r\n\r\nx", b"Content-Type: multipart/mixed\r\n\r\nno boundary",
           b"Content-Type: text/plain\r\n\r\none", b"Content-Type: text/plain\r\n\r\ntwo"]
    df = spark.createDataFrame([(1, None if b is None else bytearray(b)) for b in bad], "uid bigint, raw binary")
    out = [r.body for r in mime.bodies_and_attachments(mime.message_leaves(df)).collect()]
    assert len(out) == len(bad) and {"one", "two", ""} <= set(out)


def random_mail(rng, depth=0):
    """A message or part of random structure, types, encodings and names."""
    eol = rng.choice(["\r\n", "\n"])
    if depth < 3 and rng.random() < (0.6 if depth == 0 else 0.3):
        boundary = rng.choice(["=_b", "=_b2", "x(y)+z", "--in--"]) + str(depth)
        kind = rng.choice(["mixed", "alternative", "related"])
        quoted = f'"{boundary}"' if rng.random() < 0.7 or "(" in boundary else boundary
        lines = [f"Content-Type: multipart/{kind};", f" boundary={quoted}", "", rng.choice(["", "preamble --" + boundary])]
        for _ in range(rng.randrange(0, 4)):
            lines += [f"--{boundary}{rng.choice(['', ' '])}", random_mail(rng, depth + 1)]
        if rng.random() < 0.9:
            lines += [f"--{boundary}--", rng.choice(["", "epilogue", f"--{boundary}"])]
        return eol.join(lines)
    text = rng.choice(["", "Plain text.", "a = b & c\n\nd", "<p>x</p>", "J'ai réussi", "café ✓ " * 10, "From x"])
    encoding = rng.choice(["", "7bit", "8bit", "base64", "quoted-printable", "QUOTED-PRINTABLE"])
    charset = rng.choice(["utf-8", "UTF-8", "iso-8859-1", "us-ascii", "latin1", ""])
    data = text.replace("\n", eol).encode("utf-8" if charset.lower() in ("utf-8", "") else "latin-1", "replace")
    if encoding == "base64":
        body = base64.encodebytes(data).decode().replace("\n", eol)
    elif encoding.lower() == "quoted-printable":
        body = quopri.encodestring(data).decode("latin-1").replace("\n", "\n")
    else:
        body = data.decode("latin-1")
    heads = [f"X-{k}: y" for k in range(rng.randrange(3))]
    if rng.random() < 0.9:
        kind = rng.choice(["text/plain", "text/html", "TEXT/Plain", "application/pdf", "image/png", "message/rfc822", "bad"])
        heads.append(f"Content-Type: {kind}" + (f"; charset={charset}" if charset else "") + rng.choice(
            ["", "; name=r.pdf", ';\n\tname="a \\" b.txt"']).replace("\n", eol))
    if encoding:
        heads.append(f"{rng.choice(['Content-Transfer-Encoding', 'content-transfer-encoding'])}: {encoding}")
    if rng.random() < 0.3:
        heads.append(rng.choice(["Content-Disposition: inline", "Content-Disposition: attachment",
                                 'Content-Disposition: Attachment; filename="x y.csv"', 'Content-Disposition: inline; filename=""']))
    rng.shuffle(heads)
    return eol.join([*heads, "", body])


def test_columns_and_walk_agree(spark):
    """Leaves from column expressions and from the walk in Python, over mails of random structure."""
    rng = random.Random(11)
    mails = [random_mail(rng).encode("latin-1", "replace") for _ in range(600)]
    df = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(mails)], "uid bigint, raw binary")

    def compared(rows):
        """Of nested mails the walk gives the size of a new rendering; multiparts without parts are neither text nor
        attachment."""
        return [x[:3] + (None if x[0] == "message/rfc822" else x[3], x[4]) for x in rows if not x[0].startswith("multipart/")]

    for r in mime.message_leaves(df).collect():
        assert compared(map(tuple, r.leaves)) == compared(mime._leaves(mails[r.uid])), mails[r.uid]


def test_a_multipart_is_split_once_at_each_level(spark):
    """Expressions over lists are evaluated wherever they stand: a multipart is split at its end and at its marks, once."""
    df = spark.createDataFrame([(1, bytearray(b""))], "uid bigint, raw binary")
    plan = mime.message_leaves(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 2 * (mime.LEVELS + 1) + 1  # and once for quoted-printable
    text = mime.bodies_and_attachments(mime.message_leaves(df))._jdf.queryExecution().analyzed().toString()
    assert "Contains(" in text or "contains(" in text


@pytest.mark.parametrize("raw, body", [
    ("\nNo head", "No head"), ("X: y", ""), ("X: y\n z", ""), ("X: y\nno header line", "no header line"),
    ("X: y\n \n\nA\n\nB", "A\n\nB"), ("X: y\nContent-Type: text/plain\n\n\nA", "A"),
    (multi("mixed", part("text/html", "<p> </p>"), part("text/plain", "A & B")), "A & B"),
])
def test_heads_end_at_the_first_blank_line(spark, raw, body):
    assert read(spark, raw)[0].replace("\r\n", "\n") == body
    assert read(spark, raw.encode())[0] == body
