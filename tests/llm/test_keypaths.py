import random
import time

import pytest

from lodestrata.llm import credentials, keypaths

PATHS = [
    ("a.yaml", "password:\n  value: hunter2Xyz9\n", "password.value", 1), ("a.json", '{"credentials": {"value": "hunter2Xyz9"}}', "credentials.value", 0), ("a.toml", '[secret]\nvalue = "hunter2Xyz9"\n', "secret.value", 1),
    ("a.yaml", "password: >-\n  hunter2Xyz9\n", "password", 1), ("a.yaml", "password: 12345678\n", "password", 0), ("a.yml", "db: {user: svc, password: hunter2Xyz9, port: 5}\n", "db.password", 0), ("a.yml", "env:\n- name: DB_PASSWORD\n  value: hunter2Xyz9\n", "env.DB_PASSWORD", 2),
    ("a.json", '{"a": [{"name": "API_TOKEN", "value": "hunter2Xyz9"}]}', "a.API_TOKEN", 0), ("a.xml", "<c><add key='DbPassword' value='hunter2Xyz9'/></c>", "c.add.DbPassword", 0), ("a.xml", "<c>\n<secret>\n <value>hunter2Xyz9</value></secret></c>", "c.secret.value", 2),
    ("a.plist", "<dict><key>AuthToken</key>\n<string>hunter2Xyz9</string></dict>", "dict.AuthToken", 1), (".env", "DB_PASSWORD=hunter2Xyz9\n", "DB_PASSWORD", 0), ("a.toml", 'x = {token = "hunter2Xyz9"}\n', "x.token", 0), ("a.toml", "password = '''\nhunter2Xyz9'''\n", "password", 1),
    ("s.yml", "kind: Secret\ndata:\n  any: RmRYWFBDb1VKIzFDYg==\n", "data.any", 2), ("a.json", '{"secrets": {"deploy": "hunter2Xyz9"}}', "secrets.deploy", 0), ("a.yml", "tokens:\n- x\npasswords:\n- hunter2Xyz9\n", "passwords", 3),
]
HARMLESS = [
    ("a.json", '{"password": {"type": "string", "description": "at least x9 letters"}}'), ("a.json", '{"tokens": {"count": "hunter2Xyz9"}, "name": "hunter2Xyz9"}'), ("a.yml", "password_policy:\n  value: hunter2Xyz9\n"), ("a.yml", "secret:\n  name: hunter2Xyz9\n"),
    ("a.yml", "port: 12345678\ntoken: 12345678\n"), ("a.yml", "password:\n  valueFrom:\n    secretKeyRef: {name: db-1Xyz, key: pw}\n"), ("a.yml", "secrets:\n  db:\n    file: ./db9.txt\n"), ("a.toml", '[secret]\npath = "a9/b"\n'), ("a.yml", "env:\n- name: DB_PASSWORD\n  value: ${DB_PASSWORD}\n"),
]


@pytest.mark.parametrize("path,text,key,line", PATHS)
def test_the_whole_key_path_decides_and_the_structure_stays(path, text, key, line):
    raw = text.encode()
    (span,) = credentials.scan_bytes(raw, path)
    assert (span[0], span[4]) == (line, key)
    blank, n = credentials.redact_bytes(raw, path)
    assert n == 1 and credentials.scan_bytes(blank, path) == []
    before, after = [[(v.path, v.quoted) for v in keypaths.values(t, keypaths.format_of(t, path))] for t in (text, blank.decode())]
    assert before == after


@pytest.mark.parametrize("path,text", HARMLESS)
def test_paths_that_make_a_value_harmless(path, text):
    assert credentials.scan_bytes(text.encode(), path) == []


@pytest.mark.parametrize("path", ["a.json", "a.yaml", "a.toml", "a.xml", "a.py", ".env"])
def test_odd_texts_are_read_in_linear_time(path):
    r = random.Random(1)
    bits = ["{", "}", "[", "]", '"', "'", ":", "=", "\n", " ", "- ", "password", "token: ", "<a>", "</a>", "\\", "#", "|", "é", "x9", "'''", "<!--", "&", "://a:b"]
    for _ in range(150):
        text = "".join(r.choices(bits, k=80))
        for no, start, end, _, _ in credentials.scan_text(text, path):
            assert text.count("\n", 0, start) == no and start < end <= len(text)
    for unit in ("password: a\n", "{", "[", '"', "a: {", "<a ", "password = '", "x_", "- ", "<!--", 'password="""', "://x:y", "(", "k: |\n", "a:b", "eyJ", "-----BEGIN PRIVATE KEY-----\n"):
        began = time.process_time()
        credentials.scan_text("password\n" + unit * 4_000, path)
        assert time.process_time() - began < 4, unit


def test_long_keys_and_long_passwords_and_wide_texts():
    for text, path in (("x = 'https://u:" + "a1B" * 100 + "@host/'", "a.py"), ("k" * 90 + "_password = 'hunter2Xyz9'", "a.py")):
        assert len(credentials.scan_bytes(text.encode(), path)) == 1
    raw = 'id = 1\npassword = "x9!kLmQ2"\n'.encode("utf-16-le")
    ((no, s, e, _, _),) = credentials.scan_bytes(raw, "a.py")
    assert no == 1 and raw[s:e].decode("utf-16-le") == "x9!kLmQ2" and credentials.redact_bytes(raw, "a.py")[0].decode("utf-16-le") == 'id = 1\npassword = "REDACTED"\n'
    assert credentials.scan_bytes(b"x" * 9000 + b"\0\npassword = 'Tr0ub4dor-zebra'", "a.py") != []


def test_overlaps_are_told_however_many_spans_there_are():
    text = " ".join(f"https://u:S3cretPw{i}@h/x" for i in range(300)) + " token='S3cretPw0'"
    spans = credentials.scan_text("\n" + text, "a.py")
    assert len(spans) == 301 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_a_text_without_an_end_is_read_to_the_next_space():
    assert [(s[1], s[2]) for s in credentials.scan_text("x\npassword=\"Tr0ub4dor-zebra and more", "a.py")] == [(12, 27)]
