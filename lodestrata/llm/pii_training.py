"""Sentences with marked personal information, made from invented parts.

Names are put together from syllables, numbers are drawn at random, so that the
field learns forms and surroundings rather than particular names. Sentences
without items hold what looks alike: versions, addresses of hosts, check sums,
timings, file names, package versions, remote names and headings.
"""

from __future__ import annotations

import random
import re

START = "Ba Ka Mi Lo Ve Sa Do Ri Te Na Jo Fi Gu Pe Al Er Os Ul In Ze Ra Hu".split()
MIDDLE = "la ri no me ta ko di vi sa ru le bra to ni".split()
GIVEN_END = "a o n ra na k s e ia l el in is".split()
FAMILY_END = "ov berg sen ez ini ski ard er mann son eau ade ic ani holm dal ott ward ell enko stad way ing etti elka umi oro".split()
HAN_FAMILY = "王李张刘陈杨赵黄周吴郑冯蒋沈韩朱秦许何吕孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛"
HAN_GIVEN = "明芳磊静伟娜强敏军洋勇艳杰娟涛超霞平刚桂英文清秋雪晨雨泽宇浩然子轩梓涵墨川岚微青"
TOWNS = ["Ashford", "Millbrook", "Lindenau", "Rotwasser", "Port Elden", "Greyhaven", "Sollerby", "Monteluna", "Wexcombe", "Fenwick Bay"]
STREETS = ["Maple", "Stone Bridge", "Harbour View", "Elm Tree", "Rose", "Mill Pond", "Kingsley", "Long Acre"]
KINDS_EN = ["Street", "Road", "Rd", "Lane", "Court", "Close", "Ave.", "Avenue", "St", "Drive", "Way"]
SYMBOLS = ["load_index", "parse_header", "merge_plan", "rotate_lease", "commitBatch", "late_fold_spool"]
FILES = ["core/parser.rs", "lib/queue.py", "web/view.ts", "db/schema.sql", "conf/app.toml"]


def _cap(r: random.Random, ends: list[str], most: int) -> str:
    word = r.choice(START) + "".join(r.choice(MIDDLE) for _ in range(r.randint(0, most))) + r.choice(ends)
    return word


def name(r: random.Random) -> str:
    given, family = _cap(r, GIVEN_END, 1), _cap(r, FAMILY_END, 1)
    form = r.random()
    if form < 0.13:
        family += "-" + _cap(r, FAMILY_END, 1)
    if form > 0.87:
        return f"{given} {family}".upper()
    if form > 0.75:
        return f"{given[0]}. {family}"
    if form > 0.63:
        return f"{given} {r.choice('ABCDEFHKLMNRST')}. {family}"
    if form > 0.52:
        return f"{family}, {given}"
    return f"{given} {family}"


def han_name(r: random.Random) -> str:
    return r.choice(HAN_FAMILY) + "".join(r.choice(HAN_GIVEN) for _ in range(r.choice((1, 2, 2))))


def d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def phone(r: random.Random) -> str:
    return r.choice((
        lambda: f"+49 {d(r, 2)} {d(r, 4)} {d(r, 4)}", lambda: f"0049 (0){d(r, 2)} {d(r, 7)}", lambda: f"+1 {d(r, 3)} {d(r, 3)} {d(r, 4)}",
        lambda: f"+1.{d(r, 3)}.{d(r, 3)}.{d(r, 4)}", lambda: f"({d(r, 3)}) {d(r, 3)}-{d(r, 4)}", lambda: f"{d(r, 3)}-{d(r, 3)}-{d(r, 4)}",
        lambda: f"{d(r, 3)} {d(r, 3)} {d(r, 4)}", lambda: f"0{d(r, 2)}/{d(r, 6)}-{d(r, 2)}", lambda: f"0{d(r, 3)}/{d(r, 7)}",
        lambda: f"+44 (0){d(r, 2)} {d(r, 4)} {d(r, 4)} ext. {d(r, 2)}", lambda: f"+44 (0){d(r, 2)} {d(r, 4)} {d(r, 4)}", lambda: f"+34 {d(r, 3)} {d(r, 3)} {d(r, 3)}",
        lambda: f"+86 1{d(r, 2)} {d(r, 4)} {d(r, 4)}", lambda: f"1{d(r, 2)}-{d(r, 4)}-{d(r, 4)}", lambda: f"+{d(r, 11)}", lambda: f"+33 {d(r, 1)} {d(r, 2)} {d(r, 2)} {d(r, 2)} {d(r, 2)}",
    ))()


def _born(r: random.Random) -> str:
    return f"{r.randint(1940, 2005)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"


def han_id(r: random.Random) -> str:
    first = d(r, 6) + _born(r) + d(r, 3)
    total = sum(int(c) * (2 ** (17 - i) % 11) for i, c in enumerate(first))
    last = "10X98765432"[total % 11]
    return first + (last if last != "X" else "7") if r.random() < 0.7 else first + d(r, 1)


def labelled_id(r: random.Random) -> tuple[str, str]:
    letter = lambda: r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
    return r.choice((
        lambda: ("SSN ", f"{d(r, 3)}-{d(r, 2)}-{d(r, 4)}"), lambda: ("social security: ", f"{d(r, 3)} {d(r, 2)} {d(r, 4)}"),
        lambda: ("DNI ", d(r, 8) + letter()), lambda: ("Steuer-ID ", f"{d(r, 2)} {d(r, 3)} {d(r, 3)} {d(r, 3)}"), lambda: ("personnummer ", f"{_born(r)[2:]}-{d(r, 4)}"),
        lambda: ("passport no. ", letter() + d(r, 8)), lambda: ("driver licence ", letter() + letter() + d(r, 6) + letter()),
        lambda: ("residence permit ", f"{letter()}{d(r, 2)}-{d(r, 5)}-{d(r, 2)}"), lambda: ("national ID ", han_id(r)), lambda: ("身份证 ", han_id(r)), lambda: ("NHS number ", f"{d(r, 3)} {d(r, 3)} {d(r, 4)}"),
    ))()


def bare_id(r: random.Random) -> str:
    return r.choice((han_id(r), f"{d(r, 3)}-{d(r, 2)}-{d(r, 4)}", han_id(r)))


def email(r: random.Random) -> str:
    a, b = _cap(r, GIVEN_END, 1).lower(), _cap(r, FAMILY_END, 1).lower()
    local = r.choice((f"{a}.{b}", f"{a}_{b}{d(r, 2)}", f"{a[0]}{b}", f"{a}+review", b, f"{a}{d(r, 2)}"))
    host = r.choice(("mail.example", "post.lindenau.test", "greyhaven.example", "box.invalid", "corp-mail.org", "example.com", "web.de"))
    host = host.upper() if r.random() < 0.12 else host
    if r.random() < 0.15:
        host = host.replace(".", r.choice((" (dot) ", " [dot] ", " dot ")))
    return local + r.choice(("@", "@", "@", "@", " at ", " (at) ", " [at] ")) + host


def address(r: random.Random) -> str:
    n, town = r.randint(1, 1900), r.choice(TOWNS)
    street = f"{n} {r.choice(STREETS)} {r.choice(KINDS_EN)}"
    return r.choice((
        lambda: f"{street}, {town}, {r.choice(('OH', 'WA', 'NY'))} {d(r, 5)}", lambda: f"{street}\n{town}, {r.choice(('WA', 'CA'))} {d(r, 5)}", lambda: f"{street}, Apt {r.randint(1, 40)}, {town} {d(r, 5)}",
        lambda: f"Flat {r.randint(1, 30)}, {street}, {town}", lambda: f"P.O. Box {n}, {town}", lambda: f"{r.choice(('Ahorn', 'Birken', 'Schloss', 'Berg'))}{r.choice(('weg', 'gasse', 'straße', 'str.', 'allee'))} {n % 120}{r.choice(('', '', 'a', 'b'))}, {d(r, 5)} {town}",
        lambda: f"Am {r.choice(('Bachufer', 'Steintor', 'Rosenberg'))} {n % 120}{r.choice(('', 'b'))}, {d(r, 5)} {town}", lambda: f"Calle de la {r.choice(('Rosa', 'Fuente', 'Luna'))} {n % 90}, {n % 5 + 1}º {r.choice('ABC')}, {d(r, 5)} {town}",
    ))()


def han_address(r: random.Random) -> str:
    return f"{r.choice(('青山', '海宁', '临川', '白石'))}市{r.choice(('中山', '人民', '建设', '长春'))}路{r.randint(1, 200)}号{r.randint(1, 9)}栋{r.randint(101, 909)}室"


PROSE = (
    "In short, the lookup by queue keeps the cached plan even though v{v} fixed the spool.", "On the nightly lane, the first batch waits {n} ms for {sym}.", "Looking only at {file}, the helper behind {sym} drops every late row.",
    "Took 1 {n3} ms, then 2 {n3} ms.", "Checksum {d10} on shard {n}.", "Snowflake {d19} is a row id.", "Version {v}-{d4} ships on Friday.", "Listening on 10.{n2}.{n2}.{n2}:{d4}.", "See ticket RVW-{d5} and build {d6}.",
    "Commit {hex} changed {file}.", "Pinned parserlib@{v} in the lockfile.", "Clone from git@forge.invalid:team/unit.git first.", "Seit dem Umbau prüft die Komponente den Eintrag {n}, bis v{v} erscheint.", "Laut Protokoll sperrt die Gruppe {n} alle Zeilen.",
    "Unter Last verliert der Leser von {file} den Rest der Änderung.", "Ohne Puffer kürzt die Prüfung {n} von {d4} Zeilen.", "Según la traza, el grupo {n} repite la segunda mitad de {sym}.", "Sin caché, el equipo build revisa {file}.", "按照日志，第{n}组跳过了{n}/{d4} 个文件。", "Verdict: approve with notes.",
    "## Next steps", "# Demote Cache Window", "return Err(Error::Parser(\"late row\".into()));", "The row 2025-03-{n2} {n2}:{n2}:{n2} is late.", "Half of the time the reader at {file} holds the lease.", "We looked at main.rs and at lib.py again.", "Request {uuid} failed on cache-{n2}.core.invalid.",
    "Review Queue and Planner disagree.", "As noted, explained in Section Two.", "The Apache License applies; Third Party Notices follow.", "Offset {d8} of {d9} bytes.", "Im Zweig v{v} meldet das Team Storage {n} Fehler.", "Read the Release Notes first. Ask On Call Support.", "port {d4}, pid {d6}, seed {d10}", "@release-bot please rerun {sym}", "Ask the {Cap} {Cap} or @build-bot.", "Tell the {Cap} {Cap} about {sym}.", "Das {Cap} Team prüft {file}.",
    "The {Cap} {Cap} signs off.", "Ask the Release Manager or @docs-bot.", "Sample row: {d19}, please mask it.",
)


def prose(r: random.Random) -> str:
    fill = {
        "v": f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 12)}", "n": str(r.randint(1, 999)), "n3": f"{r.randint(100, 999)}", "n2": f"{r.randint(10, 59)}", "sym": r.choice(SYMBOLS), "file": r.choice(FILES),
        "Cap": r.choice(("Release", "Build", "Duty", "Data", "Staff", "Night", "Shift", "Queue")) if r.random() < 0.5 else r.choice(("Captain", "Manager", "Lead", "Officer", "Board", "Desk", "Crew", "Owner")),
        "n1": str(r.randint(1, 9)), "n0": str(r.randint(0, 2)), "n2d": f"{r.randint(1, 28):02d}", "hex": f"{r.getrandbits(160):040x}", "uuid": f"{r.getrandbits(32):08x}-{r.getrandbits(16):04x}-4{r.getrandbits(12):03x}-8{r.getrandbits(12):03x}-{r.getrandbits(48):012x}",
        **{f"d{n}": d(r, n) for n in (4, 5, 6, 8, 9, 10, 19)},
    }
    text = re.sub(r"\{(\w+)\}", lambda m: fill[m[1]], r.choice(PROSE))
    return text.upper() if r.random() < 0.12 and "@" not in text else text


MARKED = (
    "I talked to <name> about {sym} yesterday.", "Thanks to <name> for the trace.", "assigned to <name>", "assigned to <name>", "Reviewer <name>, <email>", "Signed-off-by: <name> <<email>>", "Reported-by: <name> <<email>>", "Author: <name> <<email>>", "Co-authored-by: <name> <<email>>",
    "Dr. <name> wants {sym} gone.", "Prof. <name> agrees.", "<name> saw the same thing on {sym}.", "<name> hat {sym} geprüft. Tel. <phone>, am besten vor dem Lauf.", "Frau <name> erreicht man unter <phone>.", "Herr <name> erreicht man unter <phone>.", "<name> ya revisó {sym}.", "Ask <name> or <name> first.",
    "{\"owner\": \"<name>\", \"phone\": \"<phone>\", \"mail\": \"<email>\"}", "| <name> | <phone> | <id> |", "| <name> | <phone> | <bare> |", "-- \n<name>\n<address>\n<phone>", "-- \n<name>\n<address>\n<email>", "cc: <email>; <email>", "Ping <email> if {sym} breaks again.", "mail to <<email>> bounced while {sym} was running.",
    "The reply-to still says <email> in {sym}.", "Rückfragen bitte an <email>.", "Escribe a <email> antes de fusionar.", "On call tonight: <phone>.", "Para dudas, llamar al <phone>.", "Bei Fragen <phone> anrufen.", "Call <phone> before touching {sym}.", "<phone> rang twice about {sym}.", "The fixture had tel=<phone> in it.", "Sample row: <id>, please mask it.", "Sample row: <bare>, please mask it.", "The first line of {sym} shows <bare> in clear.", "<id> was pasted into {sym} by mistake.",
    "The first line of {sym} shows <id> in clear.", "Im Protokoll steht <id>.", "El campo contiene <id>.", "Office moved, now <address>.", "Ship the test device to <address>.", "The record in {sym} reads <address> and must go.", "Paket an <address> schicken.", "La dirección <address> sale en el registro.",
    "请联系<han>，电话 <phone>。", "<han> 的邮箱是 <email>，已写进 {sym}。", "寄到<hanaddr>，收件人<han>。", "身份证 <hanid> 出现在 {sym} 的日志里。", "请把设备送到<hanaddr>。",
)


def marked(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, gold = "", []
    for part in re.split(r"(<(?:name|email|phone|id|bare|address|han|hanaddr|hanid)>|\{sym\})", r.choice(MARKED)):
        if part == "{sym}":
            text += r.choice(SYMBOLS)
        elif not re.fullmatch(r"<\w+>", part):
            text += part
        else:
            kind = part[1:-1]
            if kind == "id":
                label, value = labelled_id(r)
                text += label
                kind = "id_number"
            else:
                kind, value = {
                    "name": ("name", name), "email": ("email", email), "phone": ("phone", phone), "bare": ("id_number", bare_id), "address": ("address", address),
                    "han": ("name", han_name), "hanaddr": ("address", han_address), "hanid": ("id_number", han_id),
                }[kind]
                value = value(r)
            gold.append((len(text), len(text) + len(value), kind))
            text += value
    return text, gold


def examples(count: int = 2400, seed: int = 11) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``count`` short texts of one to four sentences with their gold segments."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        text, gold = "", set()
        for _ in range(r.randint(1, 4)):
            piece, marks = marked(r) if r.random() < 0.55 else (prose(r), [])
            text += r.choice(("", "- ", "* ")) if not text or text.endswith("\n") else ""
            gold |= {(s + len(text), e + len(text), k) for s, e, k in marks}
            text += piece + r.choice((" ", " ", "\n", "\n\n"))
        out.append((text, gold))
    return out
