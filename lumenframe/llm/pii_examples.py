"""Labelled spans for the personal-data model, written by a seeded grammar.

An example is a lead, a value in some format, and a tail.  How likely it is
personal depends on its format and its lead together, so labels near the border
are drawn, not ruled: a number grouped like a telephone number is personal after
neutral words, rarely so after an order's, and an odd grouping only where the
lead speaks of telephones.  The words of the leads are known to this module
alone; the model learns what it needs of them from the examples.  Every fourth
lead is kept for evaluation, so that held-out examples are worded in ways that
the fit has not seen.
"""

from __future__ import annotations

import random
import string

# Leads that speak for a kind, and leads that speak of other numbers and names.
LEADS = {
    "phone": "call|phone|tel|ring me on|mobile|cell|fax|dial|text me at|my number is|call me at|phone number|hotline|office line|home number|whatsapp|reach us by phone at|leave a message on|telefon|ruf an unter|handy|rufnummer|téléphone|appelez le|portable|numéro|llame al|teléfono|móvil|número",
    "card": "card|visa|credit card|pay with|mastercard|debit card|charged to|paid by card|card number|my card is|billing|card on file|karte|kreditkarte|kartennummer|zahlung mit|carte bancaire|carte|payé avec|numéro de carte|tarjeta|tarjeta de crédito|pagar con|cobrar a",
    "ssn": "ssn|social security|social security number|social|taxpayer id|tax id|ssn is|insured under|national id|identity number|social no|born in 1980 ssn",
    "iban": "iban|account|bank account|wire to|transfer to|bank details|pay into|deposit to|konto|überweisung an|bankverbindung|kontonummer|compte|virement|rib|compte bancaire|cuenta|cuenta bancaria|transferir a|depositar en",
    "email": "mail|email|write to|contact|e-mail me|send it to|questions to|my address is|reach me|cc|schreib an|kontakt|mail an|adresse|écrivez à|courriel|contactez|adresse de|escribe a|correo|contacto|envía a",
    "secret": "key|api key|token|credentials|secret|access key|bearer|private key|auth|login with|signing key|client secret|schlüssel|zugang|geheimnis|passwort|clé|jeton|identifiants|mot de passe|clave|credencial|contraseña|llave",
    "ip": "host|server|logged in from|client|connected from|address|ping|remote|ssh to|request from|gateway|peer|rechner|anmeldung von|serveur|connexion de|servidor|conexión desde|visitor|login from",
}
OTHER = "order|invoice|version|isbn|page|article|chapter|items|part number|score|lot|serial|case|ticket|section|room|table|figure|reference|tracking|model|batch|total of|built in|bestellung|rechnung|seite|artikel|kapitel|version|commande|facture|réf|chapitre|pedido|factura|página|capítulo|commit|checksum|file|hash|digest|build|revision|width|height|between|scored|sold|population"
ENDINGS = ("com", "org", "net", "de", "fr", "es", "edu", "io")


def _number(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice(string.digits) for _ in range(n))


def _word(rnd: random.Random, least: int = 2, most: int = 8) -> str:
    return "".join(rnd.choice("etaoinshrdlucmp") for _ in range(rnd.randint(least, most)))


def _shape(rnd: random.Random, shape: str) -> str:
    """Digits for every 0 of a shape."""
    return "".join(rnd.choice(string.digits) if c == "0" else c for c in shape)


def _draw(rnd: random.Random, pool: str, least: int, most: int) -> str:
    return "".join(rnd.choice(pool) for _ in range(rnd.randint(least, most)))


def _check_digit(body: str) -> str:
    """The digit that makes body + digit pass the card checksum."""
    doubled = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-doubled % 10)


def _iban(rnd: random.Random) -> str:
    country, account = rnd.choice(("DE", "FR", "ES", "GB", "IT", "NL")), _number(rnd, rnd.choice((14, 16, 18, 20)))
    digits = "".join(str(int(c, 36)) for c in account + country) + "00"
    return f"{country}{98 - int(digits) % 97:02d}{account}"


def _spaced(s: str, sep: str) -> str:
    return sep.join(s[i : i + 4] for i in range(0, len(s), 4))


# A value of a kind: its text, and how likely it is personal after a lead of its kind, a neutral one, and another's.


def _phone(rnd):
    r = rnd.random()
    if r < 0.5:
        shape = rnd.choice(("(000) 000-0000", "000-000-0000", "000 000 0000", "000.000.0000", "+1 (000) 000-0000", "+1 000 000 0000", "1-000-000-0000", "+49 00 0000 0000", "+33 0 00 00 00 00", "+34 000 000 000"))
        return _shape(rnd, shape), (0.998, 0.99, 0.04)
    if r < 0.75:
        return _shape(rnd, rnd.choice(("000-0000", "0000 000000", "00000 000000", "00 00 00 00 00", "000 000 000", "0000-000-0000", "000/0000000", "00 0000 0000"))), (0.97, 0.12, 0.01)
    return _shape(rnd, rnd.choice(("000-00-0000", "0000-0000", "00/00 0000", "00.00.0000", "000 000", "00 000 000", "00.000", "0 000", "0000 0000 0000", "1900 2000", "0.0.000", "00-00-0000"))), (0.2, 0.01, 0.0)


def _card(rnd):
    body = rnd.choice("3456") + _number(rnd, rnd.choice((13, 14, 14, 14)))
    if rnd.random() < 0.5:
        s, odds = body + _check_digit(body), (0.998, 0.99, 0.2)
    else:
        s, odds = (body + str((int(_check_digit(body)) + rnd.randint(1, 9)) % 10) if rnd.random() < 0.7 else rnd.choice("01279") + _number(rnd, rnd.randint(12, 17))), (0.2, 0.01, 0.0)
    return (_spaced(s, rnd.choice(" -.")) if rnd.random() < 0.5 else s), odds


def _ssn(rnd):
    return _shape(rnd, "000-00-0000"), (0.995, 0.9, 0.02)


def _account(rnd):
    if rnd.random() < 0.5:
        s = _iban(rnd)
        return (_spaced(s, " ") if rnd.random() < 0.5 else s), (0.998, 0.99, 0.6)
    s = rnd.choice(("AB", "XK", "MM", "DE", "PN", "SN")) + _number(rnd, 2) + _draw(rnd, string.digits + "ABCDEFXYZ", 8, 20)
    return s, (0.2, 0.01, 0.0)


def _email(rnd):
    at, dot = rnd.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(at)", "."), ("at", "dot"), ("at", "dot")))
    good = rnd.random() < 0.6
    name = _word(rnd) + rnd.choice(("", "", ".", "_", "-")) + rnd.choice(("", _word(rnd), _number(rnd, 2)))
    s = f"{name} {at} {_word(rnd)} {dot} {rnd.choice(ENDINGS) if good else _word(rnd, 3, 8)}"
    if at != "at":
        return s, (0.998, 0.99, 0.9) if good else (0.9, 0.8, 0.3)
    return s, (0.995, 0.97, 0.3) if good else (0.15, 0.02, 0.0)


def _secret(rnd):
    r = rnd.random()
    if r < 0.3:
        pool = rnd.choice((string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-", string.ascii_letters + string.digits + "+/"))
        return rnd.choice(("", "", "sk-", "key_", "AK", "x")) + _draw(rnd, pool, 16, 48) + _number(rnd, 1), (0.998, 0.99, 0.15)
    if r < 0.5:
        return _draw(rnd, "0123456789abcdef", 32, 64) + _number(rnd, 1), (0.99, 0.4, 0.02)
    sep = rnd.choice("_-/")
    kind = rnd.randint(0, 4)
    if kind == 0:
        s = sep.join(_word(rnd) for _ in range(rnd.randint(3, 6))) + sep + _number(rnd, rnd.randint(1, 4))
    elif kind == 1:
        s = rnd.choice("=-_") * rnd.randint(16, 30) + _number(rnd, 1)
    elif kind == 2:
        s = "-".join(_draw(rnd, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))
    elif kind == 3:
        s = _number(rnd, rnd.randint(16, 30))
    else:
        s = "".join(_word(rnd).capitalize() for _ in range(rnd.randint(3, 5))) + _number(rnd, rnd.randint(1, 4))
    return s, (0.15, 0.01, 0.0)


def _assigned(rnd):
    """A value after a name and an equals sign or colon; the name is part of the lead."""
    if rnd.random() < 0.7:
        return rnd.choice((_draw(rnd, "0123456789abcdef", 10, 40), _draw(rnd, string.ascii_letters + string.digits + "!#%", 8, 40), _word(rnd) + _number(rnd, 2) + "!" + _word(rnd))), (0.99, 0.99, 0.9)
    return rnd.choice(("required", "optional", "changeme", "********", "<" + _word(rnd) + ">", _word(rnd, 6, 9), "string", "missing", "${" + _word(rnd) + "}")), (0.1, 0.1, 0.1)


def _ip(rnd):
    r = rnd.random()
    group = lambda: _draw(rnd, "0123456789abcdef", 1, 4)
    if r < 0.35:
        return ":".join(group() for _ in range(8)), (0.998, 0.99, 0.6)
    if r < 0.55:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4)).replace(".", rnd.choice(("[.]", "(.)", "[dot]"))), (0.998, 0.99, 0.6)
    if r < 0.8:
        return ":".join(_draw(rnd, "0123456789abcdef", 2, 2) for _ in range(rnd.choice((4, 6)))), (0.1, 0.03, 0.0)
    return ":".join(_number(rnd, 2) for _ in range(rnd.choice((3, 4)))), (0.03, 0.01, 0.0)


MAKERS = {"phone": _phone, "card": _card, "ssn": _ssn, "iban": _account, "email": _email, "secret": _secret, "ip": _ip}


def leads(kind: str | None, held_out: bool) -> list[str]:
    """Leads of a kind, or of other numbers; each fourth is for evaluation alone."""
    every = (OTHER if kind is None else LEADS[kind]).split("|")
    return [x for i, x in enumerate(every) if (i % 4 == 3) == held_out]


def example(rnd: random.Random, held_out: bool = False) -> tuple[str, str, int, int, int]:
    """text, kind, start, end, 1 if the span is personal."""
    # Keys have the most formats, so they get the most examples.
    kind = rnd.choice([*MAKERS, "secret", "secret"])
    filler = lambda n: [_word(rnd) for _ in range(rnd.randint(0, n))]
    if kind == "secret" and rnd.random() < 0.3:
        value, odds = _assigned(rnd)
        quote = rnd.choice(("", "", '"', "'"))
        lead = " ".join([*filler(4), rnd.choice(("password", "token", "secret", "pwd", "api_key", "passwd", "access_key"))]) + rnd.choice(("=", " = ", ": ")) + quote
        tail = quote + " " + " ".join(filler(4))
        return lead + value + tail, kind, len(lead), len(lead) + len(value), int(rnd.random() < odds[0])
    value, odds = MAKERS[kind](rnd)
    which = rnd.choices((0, 1, 2), (4, 4, 3))[0]
    before = filler(5)
    if which == 0:
        before += [rnd.choice(leads(kind, held_out)), *([] if rnd.random() < 0.8 else filler(1))]
    elif which == 2:
        before += [rnd.choice(leads(None, held_out)), *rnd.choice(([], [], ["no."], ["nr."], ["#"], filler(1)))]
    lead = " ".join(before)
    lead += rnd.choice((" ", " ", ": ", " is ", " (")) if lead else ""
    tail = rnd.choice((" ", ". ", ", ", "; ", ") ", " ")) + " ".join(filler(4))
    return lead + value + tail, kind, len(lead), len(lead) + len(value), int(rnd.random() < odds[which])
