"""Secrets after an equals sign, and in alphabets of digits, small letters and mixtures."""

import random
import string

from trackloom.llm import secrets

KEY = string.ascii_letters + string.digits


def rate(letters, n, shape="value: {}", rounds=100):
    rnd = random.Random(7)
    hits = 0
    for _ in range(rounds):
        key = "".join(rnd.choices(letters, k=n))
        text = shape.format(key)
        hits += any(k == 3 and text[a:b] == key for a, k, b in secrets.scan(text))
    return hits


def test_values_after_an_equals_sign():
    plain = rate(KEY, 40)
    assert plain >= 80
    for shape in ("AWS_KEY={}", "AccountKey={};", "DB_PASS={}\n", "https://a.b/c?sig={}&x=1", "?client_id={}"):
        assert rate(KEY, 40, shape) == plain, shape


def test_a_name_takes_no_padding():
    assert [m.group() for m in secrets.CANDIDATE.finditer("A_VERY_LONG_NAME_OF_A_KEY=" + "x1" * 12 + "==")] == ["A_VERY_LONG_NAME_OF_A_KEY", "x1" * 12 + "=="]


def test_all_alphabets_are_tested():
    assert rate(string.ascii_lowercase, 200) >= 80
    assert rate(KEY + "+/-_", 60) >= 80
    # digits: 24 and more are of kind hex, fewer are tested and can't be told from plain numbers
    assert secrets.battery("31415926535897932384")[0] == "decimal"
    assert [k for _, k, _ in secrets.scan("x=" + "3" * 24)] == [2]


def test_plain_ones_stay():
    rnd = random.Random(8)
    words = "the of and to in that is was for with as on be at by had not are but from this have which they you were".split()
    for _ in range(50):
        for t in ("".join(rnd.choices(words, k=12)), "-".join(rnd.choices(words, k=9)) + "/" + "_".join(rnd.choices(words, k=5)), "01234567890123456789", "2024" * 5, "0" * 22):
            assert not secrets.scan("x=" + t), t
