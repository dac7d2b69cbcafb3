import random

import pyarrow as pa
import pytest

from sedimenta.operators.packed_fields import split_packed, split_texts

SEP, SIGN = ";&|,\t\n\r", "=:"


def brute(text):
    """(tag, value) pairs by a plain scan."""
    if text is None or text.strip() in ("", "."):
        return []
    pieces, now, quoted, k = [], "", False, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            now += text[k : k + 2]
            k += 2
            continue
        if c == '"':
            quoted = not quoted
        if c in SEP and not quoted:
            pieces.append(now)
            now = ""
        else:
            now += c
        k += 1
    pieces.append(now)
    out = []
    for p in pieces:
        p = p.strip(" \t\n\r\x0b\x0c")
        if not p:
            continue
        n = 0
        while n < len(p) and (p[n].isascii() and (p[n].isalnum() or p[n] == "_")):
            n += 1
        tag, rest = p[:n], p[n:].lstrip(" ")
        if rest and rest[0] in SIGN:
            rest = rest[1:].lstrip(" ")
        if len(rest) >= 2 and rest[0] == '"' and rest[-1] == '"':
            rest, inner = "", rest[1:-1]
            k = 0
            while k < len(inner):
                if inner[k] == "\\" and k + 1 < len(inner):
                    rest += inner[k + 1]
                    k += 2
                elif inner[k : k + 2] == '""':
                    rest += '"'
                    k += 2
                else:
                    rest += inner[k]
                    k += 1
        else:
            plain, k = "", 0
            while k < len(rest):
                if rest[k] == "\\" and k + 1 < len(rest):
                    plain += rest[k + 1]
                    k += 2
                else:
                    plain += rest[k]
                    k += 1
            rest = plain
        out.append((tag, rest))
    return out


def split(texts):
    tags, values = split_texts(pa.array(texts, pa.string()))
    return [list(zip(t, v)) for t, v in zip(tags.to_pylist(), values.to_pylist())]


FIXED = [
    None, "", ".", " . ", ";;;", "a", "a=", "a=1;b 2;c:3", 'ID "1"; note "x; y ""z"""; pseudo', ";a = 1 ;; b=2;", "a=b\\;c;d=\\\\\\;e=\\", "a=1\tb=2\nc=3", 'a="é;ü";b=ñ', "=5;*;é=1", 'a=" x "; b="";c=""""',
]


def test_fixed_cases():
    assert split(FIXED) == [brute(t) for t in FIXED]


def test_random_texts():
    rng = random.Random(3)
    parts = ["a", "tag_1", "=", ":", " ", ";", ",", "|", "\t", "\\;", "\\\\", '"x;y"', '"a""b"', '"\\""', "5'-end", "é", "&", "\n", "v.1-2"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(4000)]
    texts = [t for t in texts if len(t.replace("\\\\", "").replace('\\"', "")) >= 0]
    for t, got in zip(texts, split(texts)):
        assert got == brute(t), t
    sliced = pa.array(["zzz=1", *texts, None], pa.string()).slice(1, len(texts))
    tags, _ = split_texts(sliced)
    assert len(tags) == len(texts)


def test_one_row_per_attribute(spark):
    long = ";".join(f"k{k}=v{k}" for k in range(30_000))
    rows = [(1, "a=1;b=2", "x"), (1, "a=1;b=2", "x"), (2, None, "y"), (3, ".", None), (None, "c", "z"), (4, long, "w")]
    df = spark.createDataFrame(rows, "feature_no long, attributes string, attr_tag string")
    out = split_packed(df, "attributes", ["feature_no", "attr_tag"]).collect()
    got = sorted((r[0] or -1, r["keep_attr_tag"], r["attr_pos"], r["attr_value"]) for r in out if r[0] != 4)
    assert got == [(-1, "z", 1, ""), (1, "x", 1, "1"), (1, "x", 1, "1"), (1, "x", 2, "2"), (1, "x", 2, "2")]
    assert sorted(r["attr_pos"] for r in out if r[0] == 4) == list(range(1, 30_001))
    assert split_packed(df.limit(0), "attributes", ["feature_no"]).collect() == []


@pytest.mark.parametrize("texts", [[], [None], [""]])
def test_nothing(texts):
    assert split(texts) == [[] for _ in texts]
