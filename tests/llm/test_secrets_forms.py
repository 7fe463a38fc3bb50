"""Forms of assignments that the lexer of secrets reads, and literals of any length."""

import time

import pytest

from regspan.llm import secrets


def found(text):
    return {text[s.start:s.end] for s in secrets.lexed_spans(text)}


@pytest.mark.parametrize("text, want", [
    ('db_pwd: str = "Zk93hdUq81xx"', "Zk93hdUq81xx"),
    ('db_pwd: Optional[str] = "Zk93hdUq81xx"', "Zk93hdUq81xx"),
    ('db_pwd: str | None = "Zk93hdUq81xx"', "Zk93hdUq81xx"),
    ('const dbPwd: string = "Zk93hdUq81xx";', "Zk93hdUq81xx"),
    ('val dbPwd: String? = "Zk93hdUq81xx"', "Zk93hdUq81xx"),
    ("let db_pwd: &'static str = \"Zk93hdUq81xx\";", "Zk93hdUq81xx"),
    ('static DB_PWD: std::string::String = "Zk93hdUq81xx"', "Zk93hdUq81xx"),
    ('db_pwd = "Tr0ub4$dor9Kx"', "Tr0ub4$dor9Kx"),
    ('db_pwd = "Zk93hd${unknown}Uq81xx"', "Zk93hd${unknown}Uq81xx"),
    ("INFO: db_pwd=Zk93hdUq81", "Zk93hdUq81"),
    ("INFO: user:db_pwd=Zk93hdUq81", "Zk93hdUq81"),
    ("db_pwd = other = 'Zk93hdUq81'", "Zk93hdUq81"),
    ("const passphrase = `Zk93hdUq81xx`", "Zk93hdUq81xx"),
    ('passphrase = """Zk93hd\nUq81xx"""', "Zk93hd\nUq81xx"),
    ("passphrase = '''Zk93hdUq81xx'''", "Zk93hdUq81xx"),
    ("signing_pwd =\n    'Zk93hdUq81xx'", "Zk93hdUq81xx"),
    ("db_pwd: >-\n  Zk93hdUq81xx\n", "Zk93hdUq81xx"),
    ("db_pwd:\n  Zk93hdUq81xx\nb: 1", "Zk93hdUq81xx"),
    ('passphrase = "Correct 7 Horse, battery: Staple"', "Correct 7 Horse, battery: Staple"),
    ('passphrase = "aB3<dE6>gH9-"', "aB3<dE6>gH9-"),
    ("k = 'Zk93hdUq81xx'\ndb_pwd = ${k}", "Zk93hdUq81xx"),
    ("db_pwd" + " " * 200 + "= Zk93hdUq81xx", "Zk93hdUq81xx"),
    ("passphrase." + "service-" * 20 + "pwd = Zk93hdUq81xx", "Zk93hdUq81xx"),
])
def test_forms(text, want):
    assert want in found(text)


def test_plus_over_line_ends():
    assert found('db_pwd = "Zk93hdUq" +\n  "81xxQw7"') == found('db_pwd = "Zk93hdUq"\n  + "81xxQw7"') == {"Zk93hdUq", "81xxQw7"}
    assert found('+db_pwd = "Zk93hdUq81"\n+signing_passphrase = "Qw7Er5Ty3"') == {"Zk93hdUq81", "Qw7Er5Ty3"}


def test_references_and_types_are_no_secrets():
    for text in ('db_pwd = "${DB_PWD}"', 'db_pwd = "$DB_PWD"', "db_pwd: SecretStr = None", 'passphrase = "<your-passphrase>"', "auth:\n  user: bob"):
        assert not found(text)


def test_whole_literals_count():
    head = "a" * 5000
    assert secrets.literal_weight(head + "Zk93hdUq81xxQw7Er5Ty3" * 2000) > secrets.literal_weight(head + "b" * 42000) + 0.4


def test_every_part_of_a_joined_constant():
    parts = [f"Zk{i}hdUq{i * 7}xx" for i in range(300)]
    names = "; ".join(f"p{i} = '{x}'" for i, x in enumerate(parts))
    for text in (f"{names}; k = {' + '.join(f'p{i}' for i in range(300))}; db_pwd = k", "k = 'abc';" + "".join(f"k = k + '{x}';" for x in parts) + "db_pwd = k"):
        assert set(parts) <= found(text)


def test_time_is_linear():
    for text in ("token=" * 40_000, "a::" * 60_000, "k = k + 'abcdefgh1';" * 20_000 + "db_pwd = k", "x" * 200_000 + "=y", "a:b[" * 50_000, "pwd: a|" * 30_000, "a=`" * 50_001):
        start = time.perf_counter()
        secrets.lexed_spans(text)
        assert time.perf_counter() - start < 5
