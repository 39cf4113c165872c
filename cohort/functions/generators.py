"""Stand-in values: a closed registry of generators, each a pure expression of (key, locale, identity, value, attempt).

``key`` seeds the value, so equal keys give equal values in every table and run.  Word lists are short and our own; what
counts is the contract: deterministic, shaped for the locale, one expression without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seeds import between, derived, digits, pick

FIRST_NAMES = {
    "EN": ("Alice", "Ben", "Clara", "David", "Emma", "Frank", "Grace", "Henry", "Isla", "Jack", "Kate", "Liam", "Mia", "Noah", "Olive", "Peter"),
    "GB": ("Alfie", "Beatrice", "Callum", "Daisy", "Elliot", "Freya", "George", "Harriet", "Imogen", "Jasper", "Kieran", "Lottie"),
    "US": ("Austin", "Brooke", "Carter", "Dakota", "Ethan", "Faith", "Hunter", "Jordan", "Kayla", "Logan", "Madison", "Tyler"),
    "NL": ("Anouk", "Bram", "Daan", "Femke", "Gijs", "Hanna", "Joris", "Lotte", "Maud", "Ruben", "Sanne", "Thijs"),
    "DE": ("Anke", "Bernd", "Claudia", "Dieter", "Elke", "Fritz", "Greta", "Heinrich", "Ingrid", "Jürgen", "Karin", "Lukas"),
    "FR": ("Amélie", "Baptiste", "Camille", "Denis", "Élodie", "Fabien", "Gaëlle", "Hugo", "Inès", "Julien", "Léa", "Mathieu"),
    "ES": ("Alba", "Beatriz", "Carlos", "Diego", "Elena", "Fernando", "Gloria", "Hugo", "Inés", "Javier", "Lucía", "Mateo"),
    "IT": ("Alessia", "Bruno", "Chiara", "Dario", "Elisa", "Fabio", "Giulia", "Lorenzo", "Marco", "Noemi", "Paolo", "Sofia"),
}
LAST_NAMES = {
    "EN": ("Adams", "Baker", "Carter", "Dixon", "Ellis", "Foster", "Grant", "Harris", "Irwin", "Jones", "Knight", "Lewis", "Morgan", "Nash"),
    "GB": ("Ashworth", "Bramley", "Clegg", "Davies", "Entwistle", "Fairclough", "Hargreaves", "Kershaw", "Lockwood", "Pemberton"),
    "US": ("Anderson", "Brooks", "Cooper", "Dawson", "Evans", "Fisher", "Garcia", "Howard", "Jackson", "Miller"),
    "NL": ("de Boer", "Bakker", "van Dijk", "Jansen", "de Jong", "Mulder", "Peters", "Smit", "Visser", "de Vries"),
    "DE": ("Becker", "Fischer", "Hoffmann", "Klein", "Krüger", "Meyer", "Müller", "Schmidt", "Wagner", "Weber"),
    "FR": ("Bernard", "Dubois", "Durand", "Fournier", "Girard", "Lambert", "Lefèvre", "Moreau", "Petit", "Roux"),
    "ES": ("Álvarez", "Castro", "Delgado", "Fernández", "Gómez", "Hernández", "Martínez", "Moreno", "Navarro", "Ruiz"),
    "IT": ("Bianchi", "Colombo", "Conti", "Costa", "Esposito", "Ferrari", "Greco", "Marino", "Ricci", "Romano"),
}
CITIES = {
    "EN": ("Ashford", "Brookfield", "Clearwater", "Eastport", "Fairview", "Greenville", "Lakeside", "Milton"),
    "GB": ("Bath", "Bristol", "Cardiff", "Derby", "Exeter", "Leeds", "Norwich", "York"),
    "US": ("Austin", "Boise", "Denver", "El Paso", "Fresno", "Omaha", "Tucson", "Wichita"),
    "NL": ("Amersfoort", "Breda", "Delft", "Eindhoven", "Gouda", "Haarlem", "Leiden", "Zwolle"),
    "DE": ("Aachen", "Bremen", "Dresden", "Erfurt", "Freiburg", "Kassel", "Mainz", "Rostock"),
    "FR": ("Angers", "Bordeaux", "Dijon", "Grenoble", "Lille", "Nantes", "Rennes", "Tours"),
    "ES": ("Alicante", "Burgos", "Cádiz", "Granada", "León", "Málaga", "Oviedo", "Toledo"),
    "IT": ("Ancona", "Bari", "Cagliari", "Genova", "Lecce", "Modena", "Parma", "Udine"),
}
STATES = {
    "EN": ("North Province", "South Province", "East Province", "West Province"),
    "GB": ("Cornwall", "Devon", "Kent", "Norfolk", "Suffolk", "Surrey"),
    "US": ("Colorado", "Idaho", "Kansas", "Nevada", "Ohio", "Texas"),
    "NL": ("Drenthe", "Flevoland", "Gelderland", "Limburg", "Utrecht", "Zeeland"),
    "DE": ("Bayern", "Bremen", "Hessen", "Saarland", "Sachsen", "Thüringen"),
    "FR": ("Bretagne", "Corse", "Normandie", "Occitanie"),
    "ES": ("Aragón", "Asturias", "Galicia", "Murcia", "Navarra"),
    "IT": ("Abruzzo", "Lazio", "Liguria", "Molise", "Puglia", "Umbria"),
}
STREETS = {
    "EN": ("Oak Street", "Mill Lane", "Park Avenue", "Station Road", "Church Street", "High Street"),
    "NL": ("Dorpsstraat", "Kerkstraat", "Molenweg", "Schoolstraat", "Stationsweg", "Wilgenlaan"),
    "DE": ("Bahnhofstraße", "Gartenweg", "Hauptstraße", "Lindenallee", "Mühlweg", "Schulstraße"),
    "FR": ("rue de la Gare", "rue des Lilas", "avenue Foch", "place du Marché", "rue Pasteur", "chemin Vert"),
    "ES": ("Calle Mayor", "Calle Real", "Avenida del Sol", "Plaza Nueva", "Calle Luna", "Paseo del Río"),
    "IT": ("Via Roma", "Via Verdi", "Corso Italia", "Piazza Dante", "Via Garibaldi", "Via dei Fiori"),
}
COMPANY_SUFFIX = {
    "EN": ("Group", "Ltd", "Partners"), "US": ("Inc", "LLC", "Corp"), "NL": ("B.V.", "N.V."), "DE": ("GmbH", "AG", "KG"),
    "FR": ("SARL", "SA", "SAS"), "ES": ("S.L.", "S.A."), "IT": ("S.r.l.", "S.p.A."),
}
#: Patterns of digits: # is a digit from the seed, @ an upper-case letter.
PHONES = {"EN": "01##-###-###", "GB": "+44 7### ######", "US": "+1 555-01##-####", "NL": "+31 6 ########", "DE": "+49 15# #######", "FR": "+33 6 ## ## ## ##", "ES": "+34 6## ### ###", "IT": "+39 3## #######"}
ZIPS = {"EN": "#####", "GB": "@@# #@@", "US": "#####", "NL": "#### @@", "DE": "#####", "FR": "#####", "ES": "#####", "IT": "#####"}
COUNTRIES = ("Austria", "Belgium", "Canada", "Denmark", "Finland", "Greece", "Ireland", "Japan", "Kenya", "Norway", "Peru", "Portugal", "Sweden", "Uruguay")
COUNTRY_CODES = ("AT", "BE", "CA", "DK", "FI", "GR", "IE", "JP", "KE", "NO", "PE", "PT", "SE", "UY")
IBAN_COUNTRIES = ("NL", "DE", "FR", "ES", "IT", "BE")
PROVIDERS = ("mail.test", "post.test", "inbox.test")
EXAMPLE_DOMAINS = ("example.com", "example.org", "example.net")
LOREM = ("alias", "amet", "animi", "aut", "beatae", "dolor", "earum", "enim", "error", "esse", "facere", "fuga", "illum", "ipsam", "iste", "magni", "modi", "nemo", "nisi", "odit", "omnis", "quae", "quia", "rerum", "sequi", "sint", "ullam", "velit", "vero", "vitae")
#: Births lie 18 to 90 years before this day.
BIRTH_DAY = "2025-01-01"


@dataclass(frozen=True)
class Source:
    """What a generator may read."""

    key: Column
    locale: Column
    identity: Column
    value: Column
    attempt: Column


def _by_locale(lists: dict[str, tuple[str, ...]], src: Source, part: str) -> Column:
    """A pick from the locale's list, or the EN list where it has none."""
    s = derived(src.key, part)
    out = pick(lists["EN"], s)
    for name, values in lists.items():
        if name != "EN":
            out = F.when(src.locale == name, pick(values, s)).otherwise(out)
    return out


def _pattern(patterns: dict[str, str], src: Source, part: str) -> Column:
    """The locale's pattern, each # and @ filled from one run of digits."""
    d = digits(24, src.key, part)

    def fill(p: str) -> Column:
        out, n = [], 0
        for c in p:
            if c == "#":
                out.append(F.substring(d, n + 1, 1))
                n += 1
            elif c == "@":
                out.append(F.char(F.substring(d, n + 1, 2).cast("int") % 26 + 65))
                n += 2
            else:
                out.append(F.lit(c))
        return F.concat(*out)

    out = fill(patterns["EN"])
    for name, p in patterns.items():
        if name != "EN" and p != patterns["EN"]:
            out = F.when(src.locale == name, fill(p)).otherwise(out)
    return out


def first_name(src: Source) -> Column:
    return _by_locale(FIRST_NAMES, src, "first")


def last_name(src: Source) -> Column:
    return _by_locale(LAST_NAMES, src, "last")


def _mail_name(src: Source) -> Column:
    def plain(name: Column) -> Column:
        return F.regexp_replace(F.translate(F.lower(name), "áéèëíóúüïçñö", "aeeeiouuicno"), "[^a-z]", "")

    return F.concat(plain(first_name(src)), F.lit("."), plain(last_name(src)), between(1, 9999, derived(src.key, "mail")).cast("string"))


def domain_of(value: Column) -> Column:
    """What follows the last @ of a value, if it looks like a domain; else example.com."""
    found = F.regexp_extract(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""), r"@([A-Za-z0-9.-]+)\z", 1)
    return F.when(found != "", found).otherwise(F.lit("example.com"))


def id_local_part(identity: Column, attempt: Column) -> Column:
    """``user`` and the identity's key, odd runs as one dash, 48 characters at most, and a suffix from the second try on."""
    after = F.when(F.instr(identity, ":") > 0, identity.substr(F.instr(identity, ":") + 1, F.char_length(identity))).otherwise(identity)
    named = F.when(after == "", identity).otherwise(after)
    safe = F.substring(F.regexp_replace(named, "[^A-Za-z0-9._-]+", "-"), 1, 48)
    return F.concat(F.lit("user"), safe, F.when(attempt > 0, F.concat(F.lit("-"), attempt.cast("string"))).otherwise(F.lit("")))


def _luhn(body: Column) -> Column:
    """The check digit of 15 digits: every second one, from the right end, counts double (its digits summed)."""
    twice = F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(
        F.transform(F.split(body, ""), lambda ch, i: F.when(i % 2 == 0, F.element_at(twice, ch.cast("int") + 1)).otherwise(ch.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def credit_card(src: Source) -> Column:
    body = F.concat(F.lit("4"), digits(14, src.key, "card"))
    return F.concat(body, _luhn(body))


def iban(src: Source) -> Column:
    """Country, two check digits (98 - number mod 97, letters as 10 to 35), 16 account digits."""
    country = pick(IBAN_COUNTRIES, derived(src.key, "country"))
    account = digits(16, src.key, "account")
    letters = F.concat(*[(F.ascii(F.substring(country, i, 1)) - 55).cast("string") for i in (1, 2)])
    rest = F.concat(account, letters, F.lit("00")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
    return F.concat(country, F.lpad((F.lit(98) - rest.cast("int")).cast("string"), 2, "0"), account)


def _words(n: int, src: Source, part: str) -> list[Column]:
    return [pick(LOREM, derived(src.key, f"{part}{i}")) for i in range(n)]


def sentence(src: Source, part: str = "s") -> Column:
    """3 to 10 words, the first with a capital, and a full stop."""
    words = F.slice(F.array(*_words(10, src, part)), F.lit(1), between(3, 10, derived(src.key, part + "n")).cast("int"))
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000), F.lit("."))


def birth_date(src: Source) -> Column:
    days = between(18 * 366, 90 * 365, derived(src.key, "birth")).cast("int")
    return F.date_format(F.date_sub(F.lit(BIRTH_DAY).cast("date"), days), "yyyy-MM-dd")


GENERATORS: dict[str, Callable[[Source], Column]] = {
    "firstName": first_name,
    "lastName": last_name,
    "fullName": lambda s: F.concat_ws(" ", first_name(s), last_name(s)),
    "email": lambda s: F.concat(_mail_name(s), F.lit("@"), pick(PROVIDERS, derived(s.key, "provider"))),
    "exampleEmail": lambda s: F.concat(_mail_name(s), F.lit("@"), pick(EXAMPLE_DOMAINS, derived(s.key, "provider"))),
    "userIdEmail": lambda s: F.concat(id_local_part(s.identity, s.attempt), F.lit("@example.com")),
    "userIdEmailKeepDomain": lambda s: F.concat(id_local_part(s.identity, s.attempt), F.lit("@"), domain_of(s.value)),
    "phone": lambda s: _pattern(PHONES, s, "phone"),
    "streetAddress": lambda s: F.concat_ws(" ", between(1, 299, derived(s.key, "house")).cast("string"), _by_locale(STREETS, s, "street")),
    "secondaryAddress": lambda s: F.concat(F.lit("Apt. "), between(1, 999, derived(s.key, "apt")).cast("string")),
    "city": lambda s: _by_locale(CITIES, s, "city"),
    "state": lambda s: _by_locale(STATES, s, "state"),
    "zipCode": lambda s: _pattern(ZIPS, s, "zip"),
    "country": lambda s: pick(COUNTRIES, derived(s.key, "country")),
    "countryCode": lambda s: pick(COUNTRY_CODES, derived(s.key, "country")),
    "creditCardNumber": credit_card,
    "creditCardCVV": lambda s: digits(3, s.key, "cvv"),
    "iban": iban,
    "companyName": lambda s: F.concat_ws(" ", last_name(s), _by_locale(COMPANY_SUFFIX, s, "suffix")),
    "loremWords": lambda s: F.concat_ws(" ", *_words(3, s, "w")),
    "loremSentence": sentence,
    "loremParagraph": lambda s: F.concat_ws(" ", *[sentence(s, p) for p in ("a", "b", "c")]),
    "dateOfBirth": birth_date,
    "avatarUrl": lambda s: F.concat(F.lit("https://avatars.example/"), (derived(s.key, "avatar") % 100_000_000).cast("string"), F.lit(".png")),
    "url": lambda s: F.concat(F.lit("https://"), pick(LOREM, derived(s.key, "url")), F.lit("-"), pick(LOREM, derived(s.key, "url2")), F.lit(".example/")),
    "ipAddress": lambda s: F.concat_ws(".", *[between(1, 254, derived(s.key, f"ip{i}")).cast("string") for i in range(4)]),
}


def generate(name: str, key: Column, locale: Column, identity: Column, value: Column, attempt: Column | None = None) -> Column:
    """The stand-in for one value: ``key`` names what it follows; null and empty handling is the caller's."""
    return GENERATORS[name](Source(key, locale, identity, value, F.lit(0) if attempt is None else attempt))
