"""Redaction, keys and model texts."""

import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from triagelake.functions import digest, prompts, redact

HEX = "0123456789abcdef0123456789abcdef01234567"
SAMPLES = [
    'api_key = "abcdefghij0123456789xyz" and ghp_' + "a" * 36 + " AKIA" + "B" * 16,
    "SECRET-KEY: 'abcdefghij0123456789' gho_" + "Z" * 36,
    f'aws_secret_access_key="{HEX}"',
    f'bearer = "{HEX}" token: \'{HEX}\'',
    "postgres://u:p@host/db postgresql://u:p@host/db mongodb://a:b@c/d",
    "eyJab.eyJcd.sig -----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY-----",
    "token\u00a0= 'abcdefghij0123456789xyz' TOKEN='abcdefghij0123456789xyz'",
    "clean text with token but no value",
    "",
]


def python_redacted(text):
    for name, pattern in redact.SECRET_PATTERNS:
        text = re.sub(pattern, f"<{name}_REDACTED>", text)
    return text


def test_secrets_like_python(table):
    rows = table([(s,) for s in SAMPLES], "t string").select("t", redact.redact_secrets(F.col("t")).alias("o")).collect()
    assert [r.o for r in rows] == [python_redacted(r.t) for r in rows]


def test_extended_patterns_are_opt_in(table):
    df = table([("postgresql://u:p@host/db",)], "t string")
    assert df.select(redact.redact_secrets(F.col("t"))).first()[0] == "postgresql://u:p@host/db"
    assert df.select(redact.redact_secrets(F.col("t"), True)).first()[0] == "<DATABASE_URL_REDACTED>/db"


PERSONAL = [
    ("mail bob.smith@example.co.uk now", "mail <EMAIL_REDACTED> now"),
    ("+1 (017) 555-7713, 555-123-4567", "<PHONE_REDACTED>, <PHONE_REDACTED>"),
    ("10.0.0.255 and 999.1.1.1", "<IP_REDACTED> and 999.1.1.1"),
    ("4111 1111 1111 1111 or 4111111111111112", "<PII_REDACTED> or 4111111111111112"),
    ("SSN 123-45-6789.", "SSN <PII_REDACTED>."),
    ("GB82WEST12345698765432 GB82WEST12345698765433", "<PII_REDACTED> GB82WEST12345698765433"),
    ("see https://x.io/a?b=1 end", "see <PII_REDACTED> end"),
    ("no numbers here", "no numbers here"),
    (None, None),
]


def test_personal_data(table):
    df = table([(a,) for a, _ in PERSONAL], "t string")
    got = [r[0] for r in redact.add_redacted(df, "t", "o").select("o").collect()]
    assert got == [b for _, b in PERSONAL]
    logged = redact.add_redaction_log(df, "t", "code", "o", "log").select("o", "log").collect()
    assert [r.o for r in logged] == got
    assert [len(r.log) for r in logged] == [1, 2, 1, 1, 1, 1, 1, 0, 0]


def test_log_positions_like_finditer(table):
    rows = redact.add_redaction_log(table([(s,) for s in SAMPLES], "t string"), "t", "code", "o", "log").collect()
    for r in rows:
        text, want = r.t, []
        for name, pattern in redact.SECRET_PATTERNS:
            want += [(name, m.start()) for m in re.finditer(pattern, text)]
            text = re.sub(pattern, f"<{name}_REDACTED>", text)
        assert [(e.type, e.position) for e in r.log if e.score is None] == want
        assert all(e.field == "code" for e in r.log)


def test_clean_check(table):
    df = table([("x@y.org",), ("10.0.0.1",), ("ok",), ('token="' + HEX + '"',), ("4111111111111111",)], "t string")
    assert [r[0] for r in df.select(redact.is_clean(F.col("t"))).collect()] == [False, True, True, False, False]


def test_paths(table):
    df = table([("/Users/al/a/home/b",), ("/home/al/x",), ("C:\\Users\\al\\x",), ("src/a.py",)], "p string")
    assert [r[0] for r in df.select(redact.redact_path(F.col("p"))).collect()] == [
        "/Users/<USERNAME>/a/home/b", "/home/<USERNAME>/x", "C:\\Users\\<USERNAME>\\x", "src/a.py",
    ]


def test_whole_finding(table):
    df = table([("/home/al/a.py", 'token="' + HEX + '"'), ("b.py", None)], "file_path string, code_snippet string")
    df = df.withColumn(
        "context",
        F.when(F.col("file_path") == "/home/al/a.py", F.struct(
            F.col("file_path").alias("file"), F.lit("mail a@b.org").alias("context_code"),
            F.array(F.lit("import a"), F.lit("x@y.org")).alias("imports"))),
    )
    one, two = redact.sanitize_findings(df).collect()
    assert one.file_path == one.context.file == "/home/<USERNAME>/a.py"
    assert one.code_snippet == "<AUTH_TOKEN_REDACTED>"
    assert one.context.context_code == "mail <EMAIL_REDACTED>"
    assert one.context.imports == ["import a", "<EMAIL_REDACTED>"]
    assert two.code_snippet is None and two.context is None


@pytest.mark.parametrize("secret", ["s", "k" * 64, "k" * 65, "schlüssel"])
def test_hmac_like_python(table, secret):
    body = '{"a": "é ✓"}'
    want = hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    df = table([(body, f"sha256={want}"), (body, want), (body, None), (body + " ", f"sha256={want}")], "b string, s string")
    out = df.select(digest.hmac_sha256_hex(F.col("b"), secret).alias("h"), digest.signature_ok(F.col("b"), F.col("s"), secret).alias("ok"))
    rows = out.collect()
    assert rows[0].h == want
    assert [r.ok for r in rows] == [True, False, False, False]
    assert df.select(digest.signature_ok(F.col("b"), F.col("s"), None)).first()[0]


def test_clean_code_and_split(table):
    cases = [
        ("```python\nprint('hello')\n```", "print('hello')"),
        ("print(1)", "print(1)"),
        ("```\na\n\nb\n```", "a\n\nb"),
        ("```", ""),
        ("```\n```", ""),
        ("a\n```", "a"),
    ]
    df = table([(a,) for a, _ in cases], "r string")
    assert [r[0] for r in df.select(prompts.clean_code(F.col("r"))).collect()] == [b for _, b in cases]
    code, why = prompts.split_fix_response(F.col("r"))
    df = table([("```\nx = 1\n```\n**Explanation**: because",), ("x",), ("a **Explanation**: b **Explanation**: c",)], "r string")
    got = [tuple(r) for r in df.select(code, why).collect()]
    assert got[0] == ("x = 1", "because")
    assert got[1] == ("x", "Security fix applied")
    assert got[2] == ("a **Explanation**: b **Explanation**: c", "Security fix applied")
