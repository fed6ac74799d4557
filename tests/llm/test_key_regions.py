"""Keys in long regions of base64: the same spans as by decoding the rest of the region for every candidate, in time that grows with the text."""

import base64
import random
import re
import time

import pytest

from strandlake.llm import secrets


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + content


def rsa(rng, bits):
    number = lambda n: der(0x02, bytes([rng.randrange(1, 128)]) + rng.randbytes(n - 1))
    return der(0x30, der(0x02, b"\0") + b"".join(number(bits // k) for k in (8, 400, 8, 16, 16, 16, 16, 16)))


def ssh(rng):
    string = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(rng.randbytes(51)) + string(rng.randbytes(130))


def plain(bare):
    """Spans by decoding the whole rest for every place that may begin a key."""
    spans, end = [], 0
    for at in (m.start() for m in re.finditer("(?=M[A-I]|b3Bl)", bare)):
        if at < end:
            continue
        data = secrets.loose64(bare[at:])
        named = data.startswith(b"openssh-key-v1\0")
        top = secrets.tlv(data, 0, len(data))
        n = secrets.ssh_end(data) if named else top[2] if top and top[0] == 0x30 else 0
        to = at + (n * 4 + 2) // 3
        if n and (named or secrets.der_key(data[:n])) and secrets.decode64(bare[at:to]):
            spans.append((at, to))
            end = to
    return spans


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_decoding_the_rest(seed):
    rng = random.Random(seed)
    text = []
    for _ in range(30):
        key = rng.choice([rsa(rng, 512), rsa(rng, 1024), ssh(rng)])
        code = base64.b64encode(key).decode().rstrip("=")
        if rng.random() < 0.4:  # a byte of it is another
            at = rng.randrange(len(code))
            code = code[:at] + rng.choice("ABCDxyz09") + code[at + 1 :]
        text += [code if rng.random() < 0.8 else code[: rng.randrange(len(code))], "".join(rng.choices("ABCxyz019", k=rng.randrange(40)))]
    bare = "".join(text)
    found = secrets.coded_keys(bare, secrets.WRAPPED.match(bare))
    assert found == plain(bare) and len(found) > 5
    wrapped = "\n".join(bare[i : i + 64] for i in range(0, len(bare), 64))
    assert [(a - a // 65, b - (b - 1) // 65) for a, b in secrets.coded_keys(wrapped, secrets.WRAPPED.match(wrapped))] == found


def test_bytes_looked_at_are_those_decoded():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 50, 301):
        data = rng.randbytes(n)
        code = "xyz" + base64.b64encode(data).decode().rstrip("=")
        seen = secrets.Coded(code, 3)
        assert len(seen) == n and bytes(seen[i] for i in range(n)) == data and seen[:] == data
        for _ in range(50):
            a, b = rng.randrange(n + 3), rng.randrange(n + 3)
            assert seen[a:b] == data[a:b]
        with pytest.raises(IndexError):
            seen[n]


@pytest.mark.parametrize("piece", ["MIICXAIBAAKBgQC7", "b3BlbnNzaC1rZXktdjEA"])
def test_a_megabyte_of_beginnings(piece):
    text = piece * (1_000_000 // len(piece))
    begun = time.process_time()
    assert not [x for x in secrets.find_secrets(text) if x[0] == "key"]
    assert time.process_time() - begun < 10
