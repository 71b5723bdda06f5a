import base64
import gzip
import hashlib
import re

from pointloom.llm import secrets

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"


def spans(text):
    return secrets.joined(secrets.findings(text)[1])


def test_plain_kinds():
    text = f'password = "hunter22" and Token:abc and {KEY} then {"ab" * 12}'
    assert spans(text) == f"assign:0:20,access:{text.index('AKIA')}:{text.index(' then')},hex:{text.index('abab')}:{len(text)}"


def test_base64_maps_to_the_text():
    inner = f"my secret: {KEY} ok"
    code = base64.b64encode(inner.encode()).decode()
    text = f"see {code} there"
    got = spans(text)
    start, end = map(int, re.search(r"access:(\d+):(\d+)", got).groups())
    assert 4 <= start < end <= 4 + len(code)
    assert start == 4 + inner.index("AKIA") * 4 // 3


def test_nested_url_base64_gzip():
    inner = base64.b64encode(gzip.compress(f"token={KEY}".encode())).decode().replace("=", "%3D").replace("+", "%2B").replace("/", "%2F")
    assert "access:" in spans(f"a {inner} b")


def test_unicode_escapes_in_part():
    text = "x pass\\u0077ord=abcdefgh y"
    assert spans(text) == f"assign:2:{len(text) - 2}"


def test_same_layer_at_two_places():
    code = base64.b64encode(f"key {KEY} end".encode()).decode()
    assert spans(f"{code} and {code}").count("access") == 2


def test_ends_on_odd_input():
    for text in ("", "%", "%%41", "\\u12", "A" * 70000, "%41" * 3000, "=" * 50, "é" * 100, "ſecret=abcdefgh"):
        assert secrets.findings(text)[0] == secrets.scan(text)
    assert spans("ſecret=abcdefgh") == ""


def test_frame(spark):
    rows = [(1, "api_key=abcdefg", 1), (1, "api_key=abcdefg", 1), (None, None, 2), (3, "", 3)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_assign int")).collect()
    assert [r.n_assign for r in got] == [1, 1, 0, 0]
    assert got[0].base_sha256 == hashlib.sha256(b"assign:0:15").hexdigest()
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    red = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()
    assert [r.text for r in red] == ["[SECRET]", "[SECRET]", None, ""]


def wrapped(text):
    code = base64.b64encode(text.encode() * 3).decode()
    return "\n".join(code[i : i + 64] for i in range(0, len(code), 64))


def test_layers_within_layers():
    """Each of these hides one secret, and one span lies within what hides it."""
    import bz2
    import lzma
    import zlib
    from urllib.parse import quote, quote_from_bytes

    secret = f"my token={KEY}"
    b64 = lambda b: base64.b64encode(b).decode()
    plain = secret.encode()
    for hidden in (
        b64(gzip.compress(gzip.compress(plain))), b64(gzip.compress(bz2.compress(plain))), b64(lzma.compress(zlib.compress(plain))),
        b64(gzip.compress(b"x" * 50 + gzip.compress(plain))), quote_from_bytes(gzip.compress(plain)), b64(secret.encode("utf-16")), b64(secret.encode("utf-16-be")),
        b64(b"\x1b[31m" + plain + b"\x00\xff"), wrapped(f"{secret} and more, "), gzip.compress(plain).hex(), gzip.compress(plain).hex().upper(),
        b64(quote("".join(f"\\u{ord(c):04x}" for c in secret)).encode()), quote(quote(b64(plain))), "".join(f"&#{ord(c)};" for c in secret),
        b64(gzip.compress(gzip.compress(plain + b" " * 5000)[:-9])),
    ):
        got = secrets.findings(f"see {hidden} there")[1]
        assert any(k == 1 and 4 <= s < e <= 4 + len(hidden) for s, k, e in got), hidden


def test_layers_that_begin_anywhere():
    import zlib
    from urllib.parse import quote_from_bytes

    plain = f"my token={KEY}".encode()
    b64 = lambda b: base64.b64encode(b).decode()
    for hidden in (
        b64(b"\x00\x01head\x02\x03" + zlib.compress(plain)), "data=" + quote_from_bytes(zlib.compress(plain)), "path/" + b64(plain), "some/long-path/to_it/" + b64(plain),
        "a/" + b64(gzip.compress(plain)), "".join(f"\\u{{{c:x}}}" for c in plain), "".join(f"\\{c:03o}" for c in plain), "".join(f"%2525{c:02x}" for c in plain),
        "".join(f"&#38;#38;#{c};" for c in plain), "".join(f"\\u005cu005cu{c:04x}" for c in plain),
    ):
        got = secrets.findings(f"see {hidden} there")[1]
        assert any(k == 1 and 4 <= s < e <= 4 + len(hidden) for s, k, e in got), hidden


def test_escapes_of_escapes_take_time_in_proportion():
    import time

    began = time.time()
    base, found, layers = secrets.findings("x %" + "25" * 8000 + "41KIA" + KEY[4:] + " y")
    assert time.time() - began < 1 and layers < 10 and any(k == 1 for _, k, _ in found)


def test_small_windows_find_what_one_window_finds(monkeypatch):
    """Random nestings around a secret, with windows that cut them everywhere and with one for all."""
    import bz2
    import random
    import zlib

    monkeypatch.setattr(secrets, "LONGEST", 64)  # runs of 256 kB
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh ijkl.\n") for _ in range(n)).encode()
    wraps = [lambda b: base64.b64encode(b), lambda b: gzip.compress(b), lambda b: bz2.compress(b), lambda b: zlib.compress(b), lambda b: b.hex().encode(), lambda b: noise(rnd.randint(0, 9000)) + b"\n" + b + b"\n" + noise(rnd.randint(0, 9000))]
    for _ in range(60):
        data = noise(rnd.randint(0, 3000)) + b" password = hunter2222 " + noise(rnd.randint(0, 3000))
        for _ in range(rnd.randint(1, 4)):
            data = rnd.choice(wraps)(data)
        text = "see " + base64.b64encode(gzip.compress(noise(rnd.randint(0, 5000)) + b"\n" + data + b"\n" + noise(rnd.randint(0, 5000)))).decode()
        one, many = (secrets.findings(text, w, o)[1] for w, o in ((1 << 23, 1 << 16), (4096, 512)))
        assert {k for _, k, _ in one} == {k for _, k, _ in many} >= {0}, text[:60]


def test_percent_escape_in_a_value():
    text = "say password = %68unter2222 now"
    assert spans(text) == "assign:4:27"


def test_whole_streams_are_scanned():
    """A secret anywhere in a large stream is found, also across the edges of the windows."""
    for at in (0, 990, 1000, 5000, 9990):
        data = bytearray(b"." * 10_000)
        data[at : at + 20] = b"AKIA" + b"B" * 6 + b"C" * 10
        code = base64.b64encode(gzip.compress(bytes(data))).decode()
        for inner in (code, base64.b64encode(gzip.compress(gzip.compress(bytes(data)))).decode()):
            assert any(k == 1 for _, k, _ in secrets.findings(f"a {inner}", 1000, 100)[1])


def test_against_a_plain_scan():
    import random

    rnd = random.Random(3)
    parts = ["password", "token", '"', "'", ": ", " = ", "=", "AKIA", "ABCDEFGH12345678", "0123abcdef", "deadbeef", " ", "x", "api_key", "APIKEY", "zz", "é", "-_./+"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base, found, _ = secrets.findings(text)
        assert sorted(base) == sorted(want) and set(want) <= found
