"""The kinds that structure and context add: planted ones are found where they stand, look-alikes and prose are left alone."""

import base64
import json

import numpy as np
import pytest

from tessera.llm import pii

RNG = np.random.default_rng(21)


def drawn(alphabet, n):
    return "".join(RNG.choice(list(alphabet), n))


HEX, LOWER, UPPER, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def url64(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def jwt():
    return ".".join((url64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url64(json.dumps({"sub": drawn(DIGITS, 9)}).encode()), url64(RNG.bytes(32))))


def pem(header=""):
    body = base64.b64encode(RNG.bytes(300)).decode()
    return "-----BEGIN RSA PRIVATE KEY-----\n" + header + "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + "\n-----END RSA PRIVATE KEY-----"


#: kind, what comes before, the span, what follows
PLANTED = {
    "hex token": ("secret", 'token = "', lambda: drawn(HEX, 40), '"'),
    "upper hex": ("secret", "api_key: ", lambda: drawn(HEX, 32).upper(), ""),
    "hex without assignment": ("secret", "the secret token ", lambda: drawn(HEX, 64), " was"),
    "base 64": ("secret", "SECRET_KEY='", lambda: "aB3" + drawn(LOWER + UPPER + DIGITS + "+/", 40), "'"),
    "base 32": ("secret", "otp secret: ", lambda: drawn(UPPER + "234567", 28) + "A2B7", ""),
    "one case": ("secret", "client token=", lambda: "1a" + drawn(LOWER + DIGITS * 2, 30), ""),
    "published": ("secret", "found ", lambda: "AKIA" + drawn(UPPER + DIGITS, 16), " there"),
    "private key": ("private_key", "see\n", pem, "\n"),
    "encrypted private key": ("private_key", "", lambda: pem("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"), "."),
    "jwt": ("jwt", "Authorization: Bearer ", jwt, ""),
    "password": ("password", "password: ", lambda: drawn(LOWER, 5) + drawn(DIGITS, 3) + "!", " "),
    "quoted password": ("password", '"passwd" : "', lambda: "hunter" + drawn(DIGITS, 2), '"'),
}
CLEAN = {
    "digest": lambda: f"sha1 = {drawn(HEX, 40)}",
    "commit": lambda: f"fixed in commit {drawn(HEX, 40)} of the main line",
    "bare run": lambda: f"object {drawn(HEX, 40)} follows",
    "long word": lambda: "the token internationalisation-of-everything-at-once is a name",
    "slug": lambda: "key points: how-to-read-a-very-long-page-2024 by them",
    "repeats": lambda: f"token = {'ab' * 20}",
    "certificate": lambda: pem().replace("PRIVATE KEY", "CERTIFICATE"),
    "broken key": lambda: "-----BEGIN PRIVATE KEY-----\nnot=base=64=\n-----END PRIVATE KEY-----",
    "not a token": lambda: "eyJub3QganNvbg.eyJub3QganNvbg.abc",
    "rule": lambda: "Password: required, and password = changeme1 or password: ******** is an example",
    "sentence": lambda: "The password: choose whatever pleases",
}


def prose(n):
    return " ".join(drawn(LOWER, int(k)) for k in RNG.integers(2, 9, n))


@pytest.mark.parametrize("name", PLANTED)
def test_planted_are_found_where_they_stand(name):
    kind, before, make, after = PLANTED[name]
    for _ in range(40):
        value, lead = make(), prose(15) + ".\n"
        text = lead + before + value + after + " " + prose(15)
        at = len(lead) + len(before)
        assert [(s[0], s[1], s[2]) for s in pii.find(text)[1]] == [(at, at + len(value), kind)], text
        assert value not in pii.mask(text, pii.find(text)[1])


@pytest.mark.parametrize("name", CLEAN)
def test_clean_is_left_alone(name):
    for _ in range(40):
        text = prose(15) + ". " + CLEAN[name]() + " " + prose(15)
        assert pii.find(text)[1] == [], text


def test_prose_has_none():
    assert all(pii.find(prose(400))[1] == [] for _ in range(30))


def test_long_runs_in_linear_time():
    for run in ("-----BEGIN PRIVATE KEY-----" * 20_000, "eyJ" * 100_000 + ".", "password:" * 40_000, "a1" * 200_000, "token = " * 40_000, "Proc-Type: " * 30_000):
        pii.find(run)
