"""The small labelled table on which operator 1 is trained by default: sentences with spans marked [kind text].

Written for this library: wordings by hand, filled with names, numbers and dates drawn by a fixed seed. Each wording
with a span has others beside it in which the same shapes mean something else, and there are words with odd marks on
them, so that a shape alone is no sign.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

FIRST = "Anna Jorge Mei Marie Hans Olga Sam Zoë Peter Aisha Luca Ingrid Tomás Priya Noah Fatima Erik Chloé Yusuf Hannah Pavel Amara Kenji Lucía Owen Nadia Björn Leila Marco Sofia".split()
LAST = "Miller Díaz Wei Durand Grube Ivanova Okoro Lang Khan Bello Rossi Berg Novák Sharma Carter Haddad Lind Moreau Demir Weiss Petrov Mensah Sato Romero Hughes Aziz Holm Farah Conti Silva".split()

NAMED = """Dear Mr. {n}, thank you for the letter.|Dear {n}, we have your form.|My name is {n} and I live here.|My name is {n}.|I am {n} and I paint.|Please ask Dr. {n} about it.
Mrs. {n} met Mr. {n} today.|Contact: {n}, at the office.|Contact {n} for details.|Signed by Ms. {n} in May.|Prof. {n} gives the lecture.|Name: {n}|Name: {n}, age 41|The patient, Mr. {n}, slept well.
Attn: {n}|Sincerely, {n}|Best regards, {n}|Regards, {n}|Written by {n}.|The customer {n} called twice.|Our employee {n} has left.|Herr {n} wohnt hier.|Frau {n} kommt morgen.|Monsieur {n} est parti.|Madame {n} habite ici.
Señor {n} vive aquí.|Señora {n} llega hoy.|Customer name: {n}|Patient: {n}|He spoke to Ms. {n}.|We thank Dr. {n} and Prof. {n}.|Yours, {n}|Tenant: {n}|Employee: {n}|My sister is called {n}.|Hello Mr. {n}!|It was Miss {n} who wrote.
Mr. {n}|Mrs. {n}|Ms. {n}|Dr. {n}|Prof. {n}|Mr. {n} slept.|Mrs. {n} came in.|Ms. {n} agreed to it.|Prof. {n} is ill.|the Mr. {n}|our Mrs. {n}|Frau {n} isst.|Monsieur {n} dort.|Madame {n}|Señor {n}|Herr {n}|by Dr. {n}"""
NUMBERED = """My SSN is [natid {s}] as filed.|social security number: [natid {s}]|SSN [natid {s}].|SSN: [natid {s}]|His social security number is [natid {s}], she said.|Enter your SSN ([natid {s}]) here.|tax id [natid {s}]
Tax ID: [natid {s}]|ssn={s1}|The SSN on file is [natid {s}].|Social Security No. [natid {s}]|taxpayer id: [natid {s}]"""
BANKED = """Pay to IBAN [iban {i}] by Friday.|IBAN: [iban {i}]|My IBAN is [iban {i}].|Transfer it to [iban {i}], please.|Bank account: [iban {i}]|Account [iban {i}] at the bank.|Please transfer the rent to [iban {i}] now.|IBAN [iban {i}]
Konto: [iban {i}]|The bank account is [iban {i}].|Send the money to IBAN [iban {i}]."""
CALLED = """Call me at [local_phone {p}] tonight.|tel: [local_phone {p}]|phone [local_phone {p}], office hours.|Fax [local_phone {p}].|Phone: [local_phone {p}]|My phone number is [local_phone {p}].|Mobile: [local_phone {p}]
Cell [local_phone {p}]|Call [local_phone {p}] now.|You can reach me at [local_phone {p}].|Tel. [local_phone {p}]|Dial [local_phone {p}] for help.|text me at [local_phone {p}]|telephone: [local_phone {p}]|Fax: [local_phone {p}]"""
CLEAN = """{N} Street is long and the {N} Museum is closed.|The {N} Report was read in {N}.|On Monday {N} won the cup.|The road from {N} to {N} is dry.|In {N} it rains.|{N} and {N} were at war.|The {N} Company sells tea.|Old {N} wine is red.|Visit {N} in May.
The part {s} is out of stock.|Order {s} was sent on {d}.|Version {s} of the code.|Item {s} costs 12.99 now.|Model {s}, see below.|Ticket {s} is closed.|The hash {i} differs.|commit {i} broke it|serial {i} was found.|The key {i} fits.|File {i} is gone.|License {i} ended.
Pages {p} are missing.|The score was {p} at half time.|Lot {p} sold for 300.|Room {p} is shut.|Lines {p} were cut.|Case {p} is open.|see section {k} of the manual.|Is {k} the right key?|Born on {d} at noon.|On {d} it rained.|It cost $ {k} in {d}.|From {d} to {d} no trains ran.
the of and to in is that it was for on are as with|De la les des et en un une que qui dans pour|der die das und ist nicht von zu den mit|que de la el en y los se del las un por con|Write to a.b@mail.example.com or +1 (555) 555-0100 today.|a | b | c | d
Name your price and call it a day.|The number of the phone was lost.|Mr. and Mrs. were not in.|Call it what you like.|My name is of no account.|The bank is shut.|Contact with water is bad.|Dear God, what a day.|Sincerely is a long word.|I am here and the account is true.
Signed copies are rare.|A fax came.|Hello world, this is a test.|The patient slept.|Our customer was late.|ssn is short for a number.|Regards to all at home.|Account for it.|Mr. was all he wrote.|Dear all, the office is shut.|Transfer to the bus at noon.|Dr. is short for doctor."""
MARKS = "!#$%&*+=@^_~|<>/\\?;"
PARTS = "an bel cor dav el fen gar hol il jan kar lin mar nor os per quin ros sam tor ul ven wil yas zim".split()
SYLLABLES = "ba ko mi ru te sa lo ni fu da pe gi zu ha wo".split()


def sentences(seed: int = 5, wordings: dict[str, str] | None = None, first: list[str] = FIRST, last: list[str] = LAST, rounds: int = 15) -> list[str]:
    """The table's rows; by other wordings and names also rows to test on."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def one(of: list[str]) -> str:
        """A listed name or, more often, an invented one, so that names aren't learned by heart."""
        if wordings is not None or r.random() < 0.25:
            return r.choice(of)
        return "".join(r.choice(PARTS) for _ in range(r.choice([1, 2, 2, 3]))).capitalize() + r.choice(["", "", "a", "o", "é", "ov", "ez"])

    def name() -> str:
        middle = r.choice(["", "", "", f" {one(last)[0]}.", f" {one(last)}"])
        return r.choice([f"{one(first)} {one(last)}", f"{one(first)}{middle} {one(last)}", one(last), one(last)])

    def value(c: str) -> str:
        if c == "n":
            return f"[name {name()}]"
        if c == "N":
            return r.choice([name(), one(last), one(first)])
        if c == "s":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        if c == "i":
            tail = digits(r.choice([14, 18, 20])) if r.random() < 0.5 else "".join(r.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(4)) + digits(r.choice([10, 14]))
            return r.choice(["DE", "GB", "FR", "ES", "NL", "IT", "AT", "PL", "SE", "CH"]) + digits(2) + tail
        if c == "p":
            return r.choice([f"{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
        if c == "d":
            return r.choice([f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"1{r.randint(0, 2)}/0{r.randint(1, 9)}/19{digits(2)}", f"0{r.randint(1, 9)}.1{r.randint(0, 2)}.20{digits(2)}"])
        return r.choice([f"{digits(4)}-{digits(2)}-{digits(4)}", f"{r.choice('ABXYZ')}{digits(2)}-{digits(4)}", digits(8), f"{digits(1)}.{digits(2)}.{digits(2)}", f"{digits(2)}-{digits(2)}-{digits(2)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"])

    def fill(wording: str) -> str:
        for c in "nNsipdk":
            while "{" + c + "}" in wording:
                wording = wording.replace("{" + c + "}", value(c), 1)
        if wordings is None:
            wording = re.sub(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. (?=\[name)", lambda _: r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. "]), wording)
        return wording.replace("{s1}", f"{digits(3)}-{digits(2)}-{digits(4)}")

    def plain(n: int) -> str:
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    def amid(text: str) -> str:
        """The sentence among made-up words, as the words around a span may be any."""
        before, after = r.choice([0, 1, 2, 3]), r.choice([0, 1, 1, 2])
        text = f"{plain(before).capitalize()} {text}" if before else text
        return f"{text.rstrip('.')}{r.choice(['', '', ',', ' and'])} {plain(after)}." if after else text

    def odd(marked: bool = False) -> str:
        """A made-up word, mostly with marks on it, or marks alone."""
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        w = r.choice([w, w.capitalize(), w.capitalize(), w.upper()])
        mark = "".join(r.choice(MARKS) for _ in range(1)) * r.randint(1, 3)
        return r.choice([w + mark, w + r.choice(",.") + mark, mark + w, mark, w + digits(r.randint(1, 4)), digits(r.randint(1, 6)) + mark, *([] if marked else [w, w + r.choice(",.!?")])])

    out: list[str] = []
    for kind, text in (wordings or {"name": NAMED, "natid": NUMBERED, "iban": BANKED, "local_phone": CALLED, "": CLEAN}).items():
        out += [fill(w) if wordings is not None or i % 3 == 0 else amid(fill(w)) for i in range(rounds * (2 if kind == "name" else 1)) for line in text.split("\n") for w in line.split("|") if w]
    if wordings is None:
        out += [" ".join(odd() for _ in range(r.randint(3, 14))) for _ in range(400)]
        # words that go before spans, with odd words after them
        out += [f"{' '.join(odd() for _ in range(r.randint(0, 4)))} {cue} {' '.join(odd(True) for _ in range(r.randint(1, 5)))}".strip() for cue in "Mr. Mrs. Ms. Dr. Dear Name: Contact: tel: Phone: SSN IBAN: IBAN call account name is by".split() for _ in range(4)]
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text), the rows in order."""
    return spark.createDataFrame([(x,) for x in sentences()], "text string")
