"""LZW streams are read without a step of Python for each code, and as a plain reader reads them."""

import random
import time

import pytest

from rowproof.llm import gif


def plain(codes, clear, most):
    """Strings of codes one by one; the table stops growing at 4,096."""
    out, table, prev = [], [bytes([i]) for i in range(clear)] + [b"", b""], b""
    for code in codes:
        if prev and len(table) < gif.MOST_CODES:
            table.append(prev + (table[code] if code < len(table) else prev)[:1])
        prev = table[code]
        out.append(prev)
    return b"".join(out)[:most]


def packed(codes):
    """A stream of codes after one clear code, of 8-bit samples; twelve bits each once the table is full."""
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in [(256, 9), *((c, int(gif.WIDTHS[8][min(i, gif.MOST_CODES - 1)])) for i, c in enumerate(codes))])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def drawn(n, seed):
    """n codes of a valid stream without clear codes."""
    rng = random.Random(seed)
    return [rng.randrange(256) if i == 0 or rng.random() < 0.4 else 258 + rng.randrange(min(i, gif.MOST_CODES - 258)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 700, 3838, 3839, 9000])
def test_streams_without_clear_codes(n):
    codes = drawn(n, n)
    whole = plain(codes, 256, 1 << 30)
    for most in (len(whole), len(whole) // 2 + 1):
        assert gif.lzw_expand(packed(codes), 8, most) == whole[:most]
    bad = [*codes[:-1], 258 + n] if n < 3838 else None
    if bad:
        with pytest.raises(ValueError):
            gif.lzw_expand(packed(bad), 8, 1 << 20)


def test_reading_costs_less_than_a_step_for_each_code():
    codes = drawn(3800, 1)
    stream = packed(codes)
    most = len(plain(codes, 256, 1 << 30))

    def least(f):
        spent = []
        for _ in range(15):
            begin = time.process_time()
            f()
            spent.append(time.process_time() - begin)
        return min(spent)

    assert least(lambda: gif.lzw_expand(stream, 8, most)) < 0.6 * least(lambda: plain(codes, 256, most))
