"""The generators and scrambling in DuckDB's SQL, for oracles: same seeds, same lists, written independently of Spark."""

from __future__ import annotations

from collections.abc import Sequence

from .functions import generators as g
from .functions.locale import ALIASES, LOCALES

_KNOWN = {**{c: c for c in LOCALES}, **ALIASES}
#: The locale of a column named country.
LOCALE = f"coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in _KNOWN.items())}}}[upper(trim(country))], 'EN')"
EN = "'EN'"


def identity_key(table: str, key: str, generator: str) -> str:
    return f"('{table}:' || {key} || ':{generator}')"


def row_key(table: str, key: str, column: str) -> str:
    return f"('{table}:' || {key} || ':{column}')"


def seed(key: str) -> str:
    return f"CAST('0x' || substr(sha256({key}), 1, 12) AS BIGINT)"


def derived(key: str, part: str) -> str:
    return seed(f"({key} || '#{part}')")


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: Sequence[str], s: str) -> str:
    return f"{_list(values)}[{s} % {len(values)} + 1]"


def _between(lo: int, hi: int, s: str) -> str:
    return f"({s} % {hi - lo + 1} + {lo})"


def _local(lists: dict[str, Sequence[str]], key: str, locale: str, part: str) -> str:
    s = derived(key, part)
    whens = "".join(f" WHEN '{n}' THEN {_pick(v, s)}" for n, v in lists.items() if n != "EN")
    return f"(CASE {locale}{whens} ELSE {_pick(lists['EN'], s)} END)"


def _digits(n: int, key: str, part: str) -> str:
    runs = [f"lpad(CAST({derived(key, f'{part}{i}')} % 1000000000000 AS VARCHAR), 12, '0')" for i in range(-(-n // 12))]
    return f"substr({' || '.join(runs)}, 1, {n})"


def _pattern(patterns: dict[str, str], key: str, locale: str, part: str) -> str:
    d = _digits(24, key, part)

    def fill(p: str) -> str:
        out, n = [], 0
        for c in p:
            if c == "#":
                out.append(f"substr({d}, {n + 1}, 1)")
                n += 1
            elif c == "@":
                out.append(f"chr(CAST(substr({d}, {n + 1}, 2) AS INTEGER) % 26 + 65)")
                n += 2
            else:
                out.append(f"'{c}'")
        return " || ".join(out)

    whens = "".join(f" WHEN '{n}' THEN {fill(p)}" for n, p in patterns.items() if p != patterns["EN"])
    return f"(CASE {locale}{whens} ELSE {fill(patterns['EN'])} END)"


def _words(n: int, key: str, part: str) -> list[str]:
    return [_pick(g.LOREM, derived(key, f"{part}{i}")) for i in range(n)]


def _sentence(key: str, part: str) -> str:
    text = f"array_to_string([{', '.join(_words(10, key, part))}][1:{_between(3, 10, derived(key, part + 'n'))}], ' ')"
    return f"(upper(substr({text}, 1, 1)) || substr({text}, 2) || '.')"


def _luhn(body: str) -> str:
    """The textbook rule: from the left of 15 digits, double every first of two, less 9 above 9."""
    twice = f"CAST(substr({body}, CAST(i AS INT), 1) AS INT) * 2"
    one = f"CASE WHEN i % 2 = 1 THEN CASE WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END ELSE CAST(substr({body}, CAST(i AS INT), 1) AS INT) END"
    return f"CAST((10 - list_sum(list_transform(range(1, 16), lambda i: {one})) % 10) % 10 AS INT)"


def of(name: str, key: str, locale: str) -> str:
    """The SQL of one generator; ID-keyed ones read c_custkey and email."""
    first, last = _local(g.FIRST_NAMES, key, locale, "first"), _local(g.LAST_NAMES, key, locale, "last")

    def plain(x: str) -> str:
        return f"regexp_replace(translate(lower({x}), 'áéèëíóúüïçñö', 'aeeeiouuicno'), '[^a-z]', '', 'g')"

    mail = f"{plain(first)} || '.' || {plain(last)} || {_between(1, 9999, derived(key, 'mail'))}"
    card = f"('4' || {_digits(14, key, 'card')})"
    country = _pick(g.IBAN_COUNTRIES, derived(key, "country"))
    account = _digits(16, key, "account")
    letters = " || ".join(f"(ascii(substr({country}, {i}, 1)) - 55)" for i in (1, 2))
    check = f"lpad(CAST(98 - CAST({account} || {letters} || '00' AS HUGEINT) % 97 AS VARCHAR), 2, '0')"
    out = {
        "firstName": first,
        "lastName": last,
        "fullName": f"{first} || ' ' || {last}",
        "email": f"{mail} || '@' || {_pick(g.PROVIDERS, derived(key, 'provider'))}",
        "exampleEmail": f"{mail} || '@' || {_pick(g.EXAMPLE_DOMAINS, derived(key, 'provider'))}",
        "userIdEmail": "concat('user', c_custkey, '@example.com')",
        "userIdEmailKeepDomain": "concat('user', c_custkey, '@', split_part(email, '@', 2))",
        "phone": _pattern(g.PHONES, key, locale, "phone"),
        "streetAddress": f"{_between(1, 299, derived(key, 'house'))} || ' ' || {_local(g.STREETS, key, locale, 'street')}",
        "secondaryAddress": f"'Apt. ' || {_between(1, 999, derived(key, 'apt'))}",
        "city": _local(g.CITIES, key, locale, "city"),
        "state": _local(g.STATES, key, locale, "state"),
        "zipCode": _pattern(g.ZIPS, key, locale, "zip"),
        "country": _pick(g.COUNTRIES, derived(key, "country")),
        "countryCode": _pick(g.COUNTRY_CODES, derived(key, "country")),
        "creditCardNumber": f"{card} || {_luhn(card)}",
        "creditCardCVV": _digits(3, key, "cvv"),
        "iban": f"{country} || {check} || {account}",
        "companyName": f"{last} || ' ' || {_local(g.COMPANY_SUFFIX, key, locale, 'suffix')}",
        "loremWords": " || ' ' || ".join(_words(3, key, "w")),
        "loremSentence": _sentence(key, "s"),
        "loremParagraph": " || ' ' || ".join(_sentence(key, p) for p in ("a", "b", "c")),
        "dateOfBirth": f"strftime(DATE '{g.BIRTH_DAY}' - CAST({_between(18 * 366, 90 * 365, derived(key, 'birth'))} AS INTEGER), '%Y-%m-%d')",
        "avatarUrl": f"'https://avatars.example/' || ({derived(key, 'avatar')} % 100000000) || '.png'",
        "url": f"'https://' || {_pick(g.LOREM, derived(key, 'url'))} || '-' || {_pick(g.LOREM, derived(key, 'url2'))} || '.example/'",
        "ipAddress": " || '.' || ".join(str(_between(1, 254, derived(key, f"ip{i}"))) for i in range(4)),
    }
    return f"({out[name]})"


def scramble(column: str, text: str, start: str, end: str) -> str:
    """Characters ``start`` to ``end`` - 1 (from 0) of ``text`` scrambled within their class."""
    ch, s = f"substr({text}, CAST(i + 1 AS INT), 1)", seed(f"('{column}:' || {text} || ':' || i)")
    swapped = " ".join(f"WHEN {ch} BETWEEN '{a}' AND '{z}' THEN chr(CAST({s} % {n} + {ord(a)} AS INT))" for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
    return f"array_to_string(list_transform(range(length({text})), lambda i: CASE WHEN i < {start} OR i >= {end} THEN {ch} {swapped} ELSE {ch} END), '')"
