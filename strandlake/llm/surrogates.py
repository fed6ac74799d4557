"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, TMP, identified, store

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "given", "family")
#: Given names by script and gender; a surrogate is another name of the same list.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Camille Carla Carmen Catherine Clara Elena Elisabeth Emma Eva Hannah Helen Ingrid Isabel Jane Julia Karin Laura Linda Lucia Maria Marie Martha Mary Monika Nadine Nora Olivia Paula Petra Sarah Sofia Susan Teresa Ursula Victoria Yvonne".split(),
    ("latin", "m"): "Adam Albert Andrew Antonio Bernard Carlos Charles Daniel David Diego Edward Felix Francisco Frank George Hans Henry Jack Jacques James John Jorge Joseph Karl Kevin Lars Louis Manuel Martin Michael Miguel Oliver Paul Pedro Peter Philippe Richard Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Пётр Сергей".split(),
}
WHO = {name: key for key, names in GIVEN.items() for name in names}
TITLES = set("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split())

#: Letters whose places are kept among themselves: vowels, consonants and so on, each in both cases.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"]
CLASS_OF = {c: k for k in CLASSES for c in k}


def upper(c: str) -> str:
    """The one capital letter of ``c``."""
    return "ẞ" if c == "ß" else c.upper()


@lru_cache(maxsize=10_000)
def class_of(c: str) -> str:
    """The class of a letter or digit in either case: of those above, or else the other letters of its 128 code points that have case like it; "" for what is kept."""
    c = c.lower()
    if c in CLASS_OF or len(c) > 1 or not c.isalpha():
        return CLASS_OF.get(c, "")

    def cased(x):
        return x.lower() == x and (0 if x.upper() == x else 1 if len(upper(x)) == 1 and upper(x).isupper() and upper(x).lower() == x else None)

    first, own = ord(c) & ~127, cased(c)
    return "" if own is None or own is False else "".join(x for x in map(chr, range(first, first + 128)) if x.isalpha() and x not in CLASS_OF and cased(x) is not False and cased(x) == own)


ADDRESS_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
NUMBERS = re.compile(
    r"""(?<![\w.+])(?:
      (?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))
    | (?P<card>(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5})(?![\d]))
    | (?P<ssn>\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)
        | \+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}(?!\d)
        | (?:\(\d{3}\)[ ]?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d))
    )""",
    re.X | re.A,
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAMES = re.compile(rf"(?<!\w)(?=[A-ZÀ-ÞА-ЯЁ])({'|'.join(sorted([*WHO, *TITLES], key=len, reverse=True))})(\.?)(\s+)([A-ZÀ-ÞА-ЯЁ][\w'’-]+)(?:(\s+)([A-ZÀ-ÞА-ЯЁ][\w'’-]+))?")
CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-ÞА-ЯЁ][\w'’-]*")
#: What follows a part of a name and is none of it.
ENDING = re.compile(r"(?:['’]s)?['’-]*\Z")
#: Words that begin sentences: no names on a line of their own, and not looked for elsewhere.
NO_NAMES = set("After All Also And As At Before Both But By For From He Here How However If In It Its Later No Not Now On Or Our She So Since That The Their Then There These They This Those Thus To Was We Were What When Where Which While Who Why With Yes You Your".split())


def iban_check(text: str) -> int:
    """The remainder by 97 that an account number must have 1 of."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def luhn(digits: str) -> int:
    """The check sum of a card number's digits, 0 for a valid one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) without overlaps, in order. Forms that mean the same have one canonical form: an address in lower case, the digits of a number without its country code.

    Names are found by a title or listed given name with what follows it; wherever else their parts are in the text, they are found too.
    """
    found = []
    at = text.find("@")
    while at >= 0:
        right = ADDRESS_RIGHT.match(text, at + 1)
        if right:
            start = at  # back to what no address has, which an "@" is as well: every letter is passed once
            while start and text[start - 1] in ADDRESS_LEFT:
                start -= 1
            while start < at and text[start] in ".%+-":
                start += 1
            if start < at:
                found.append((start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in NUMBERS.finditer(text):
        kind, said = m.lastgroup if m.lastgroup not in "st" else "card", m[0]
        digits = re.sub(r"\D", "", said)
        if kind == "ip":
            if all(int(x) < 256 for x in said.split(".")):
                found.append((*m.span(), kind, ".".join(str(int(x)) for x in said.split("."))))
        elif kind == "phone":
            code = len(re.match(r"\+?(1(?=\D|\d{10}\Z)|\d{0,3})", said)[1]) if said[0] == "+" else 0
            if 7 <= len(digits) <= 15 and len(digits) - code >= 4:
                found.append((*m.span(), kind, digits[code:]))
        else:
            found.append((*m.span(), kind, digits))
    for m in IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if 15 <= len(bare) <= 34 and iban_check(bare) == 1:
            found.append((*m.span(), "iban", bare))
    own: dict[str, str] = {}
    starts = set()
    for m in NAMES.finditer(text):
        titled = m[1] in TITLES
        for k, blank in ((1, ""), (4, m[3]), (6, m[5])):
            if not m[k] or titled and k == 1:
                continue
            said = m[k][: ENDING.search(m[k]).start()] or m[k]
            if said in NO_NAMES and blank not in ("", " "):
                break
            kind = "given" if k == 1 or titled and k == 4 and said in WHO else "family"
            found.append((m.start(k), m.start(k) + len(said), kind, said))
            starts.add(m.start(k))
            if said not in NO_NAMES and (titled or k == 1 or not m[2]) and blank.count("\n") < 2:
                own.setdefault(said, kind)
    for m in CAPITAL.finditer(text) if own else ():
        said = m[0][: ENDING.search(m[0]).start()]
        for at, part in [(0, said)] if said in own else [(x.start(), x[0]) for x in re.finditer(r"\w+", said)]:
            if part in own and m.start() + at not in starts:
                found.append((m.start() + at, m.start() + at + len(part), own[part], part))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def permuted(key: bytes, tweak: str, x: int, n: int, rounds: int = 24, back: bool = False) -> int:
    """The image of ``x`` under a keyed permutation of [0, n), or with ``back`` what ``x`` is the image of: swap-or-not, a bijection for every n."""
    if n < 2:
        return x
    size = (n.bit_length() + 7) // 8
    for r in range(rounds)[:: -1 if back else 1]:
        head = f"{tweak}/{n}/{r}".encode()
        k = int.from_bytes(blake2b(head, key=key, digest_size=min(64, size + 8)).digest(), "big") % n
        partner = (k - x) % n
        hi = max(x, partner)
        if blake2b(head + hi.to_bytes(size, "big"), key=key, digest_size=1, person=b"swap").digest()[0] & 1:
            x = partner
    return x


def following(key: bytes, tweak: str, x: int, n: int) -> int:
    """What follows ``x`` when [0, n) is put in a keyed order and closed to a ring: one to one, and never ``x`` itself if n > 1."""
    return permuted(key, tweak, (permuted(key, tweak, x, n, back=True) + 1) % n, n)


def place_in_shape(text: str) -> tuple[int, int]:
    """How many texts have the shape of ``text``, and its place among them."""
    n, x = 1, 0
    for c in text:
        if k := class_of(c):
            n, x = n * len(k), x * len(k) + k.index(c.lower())
    return n, x


def in_shape(text: str, x: int) -> str:
    """The text at place ``x`` of the shape of ``text``."""
    out = []
    for c in reversed(text):
        if k := class_of(c):
            x, i = divmod(x, len(k))
            out.append(upper(k[i]) if c.isupper() else k[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def same_shape(key: bytes, tweak: str, text: str, ok=None, step=permuted) -> str:
    """``text`` with each letter and digit replaced within its class and case, by a permutation of all texts of its shape; with ``ok``, of those that it holds of (the permutation is walked on until it does). A text without letters and digits gets some."""
    n, x = place_in_shape(text)
    if n == 1 and text:
        return text + in_shape("bababababa", int.from_bytes(blake2b(f"{tweak}/{text}".encode(), key=key, digest_size=8).digest(), "big"))
    tweak = f"{tweak}/" + "".join((str(CLASSES.index(k)) if k in CLASSES else k[0]) if k else c for c, k in ((c, class_of(c)) for c in text))
    while True:
        x = step(key, tweak, x, n)
        new = in_shape(text, x)
        if ok is None or ok(new):
            return new


@lru_cache(maxsize=10_000)
def next_name(key: bytes, tweak: str, name: str) -> str:
    """The name that follows ``name`` when its list is put in a keyed order and closed to a ring: one to one, and never the name itself."""
    names = GIVEN[WHO[name]]
    ring = sorted(names, key=lambda x: permuted(key, tweak, names.index(x), len(names)))
    return ring[(ring.index(name) + 1) % len(ring)]


def ip_range(x: int) -> tuple[int, int]:
    """The first address and size of the special range that an address lies in, or all of them."""
    for base, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)):
        if base <= x < base + (1 << bits):
            return base, 1 << bits
    return 0, 1 << 32


def written(x: int) -> str:
    """The address ``x``."""
    return ".".join(str(x >> b & 255) for b in (24, 16, 8, 0))


def iban_with(country: str, body: str, odd: bool) -> str:
    """The account number with ``body``; with ``odd``, the one with the other check digits of the same remainder, "" if there is none."""
    check = 98 - iban_check(country + "00" + body)
    if odd:
        return country + {2: "99", 97: "00", 98: "01"}[check] + body if check in (2, 97, 98) else ""
    return f"{country}{check:02d}{body}"


def frame(kind: str, form: str):
    """What of a canonical form is replaced, how a form is made of that, what must hold of it (None: nothing), and what tells its kind of form apart besides its shape."""
    if kind == "email":
        body, _, last = form.rpartition(".")
        return body, lambda new: f"{new}.{last}", None, last
    if kind == "card":
        if luhn(form) == 0:
            return form[1:-1], lambda new: f"{form[0]}{new}{(10 - luhn(form[0] + new + '0')) % 10}", None, form[0] + "/valid"
        return form[1:], lambda new: form[0] + new, lambda new: luhn(form[0] + new) != 0, form[0]
    if kind == "phone" and len(form) == 10:
        area = form[0] in "23456789"
        return form, str, lambda new: (new[0] in "23456789") == area, str(area)
    if kind == "iban":
        country, odd = form[:2], not 2 <= int(form[2:4]) <= 98
        return form[4:], lambda new: iban_with(country, new, odd), (lambda new: iban_with(country, new, True)) if odd else None, f"{country}/{odd}"
    return form, str, None, ""


def ip_place(form: str) -> tuple[int, int, int, bool]:
    """An address's special range and its size, its place in it, and whether it is one of those that hosts have."""
    a, b, c, d = map(int, form.split("."))
    x = a << 24 | b << 16 | c << 8 | d
    base, size = ip_range(x)
    return base, size, x - base, bool(base or 1 <= a < 224)


def ip_at(base: int, size: int, x: int, host: bool) -> str:
    """The address at a place of a range, "" if it belongs to another."""
    new = written(base + x)
    return new if ip_place(new) == (base, size, x, host) else ""


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0, step=permuted) -> str:
    """The surrogate of a canonical form, itself canonical: one to one among the forms of a kind and shape at one ``attempt``, and within that shape. With ``following`` for ``step`` it is never the form itself."""
    tweak = f"{kind}/{attempt}"
    if kind == "ip":
        base, size, x, host = ip_place(form)
        while True:
            x = step(key, f"{tweak}/{base}", x, size)
            if new := ip_at(base, size, x, host):
                return new
    if kind == "given" and form in WHO:
        return next_name(key, f"{tweak}/{WHO[form]}", form)
    body, make, ok, more = frame(kind, form)
    return make(same_shape(key, f"{tweak}/{more}" if more else tweak, body, ok, step))


def shape_of(kind: str, form: str) -> tuple[str, int]:
    """What forms that share their possible surrogates have in common, and about how many such forms there are (2**62 for more, and for names that come from a ring)."""
    if kind == "given" and form in WHO:
        return "/".join(WHO[form]), 1 << 62
    if kind == "ip":
        base, size, _, host = ip_place(form)
        return f"{base}/{host}", size if base else size >> 4
    body, _, ok, more = frame(kind, form)
    n = place_in_shape(body)[0]
    if n == 1:
        return f"{body}/{more}", 1 << 62
    return f"{in_shape(body, 0)}/{more}", min(n * 3 // 97 if kind == "iban" and ok else n, 1 << 62)


def forms_of(kind: str, form: str, first: int, many: int):
    """The forms at ``many`` places from ``first`` of the shape of ``form``."""
    if kind == "ip":
        base, size, _, host = ip_place(form)
        yield from filter(None, (ip_at(base, size, x, host) for x in range(first, min(first + many, size))))
        return
    body, make, ok, _ = frame(kind, form)
    for x in range(first, min(first + many, place_in_shape(body)[0])):
        new = in_shape(body, x)
        if ok is None or ok(new):
            yield make(new)


def laid_out(kind: str, said: str, form: str, new: str) -> str:
    """The surrogate ``new`` in the layout of ``said``: case of letters, or punctuation and country code."""
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(said, new)) + new[len(said) :]
    if kind == "ip" or kind in ("given", "family"):
        return new
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in said)
    keep = sum(c.isdigit() for c in said) - len(new)
    rest, out = iter(new), []
    for c in said:
        if c.isdigit():
            keep -= 1
            out.append(c if keep >= 0 else next(rest))
        else:
            out.append(c)
    return "".join(out)


@lru_cache(maxsize=100_000)
def known(key: bytes, kind: str, form: str) -> str:
    return surrogate(key, kind, form)


def entities(docs: DataFrame) -> DataFrame:
    """``kind, form`` of everything found, distinct within each batch of texts."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            own = sorted({x[2:] for t in batch.column(0).to_pylist() if t for x in find_entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], pa.string()) for i in (0, 1)], ["kind", "form"])

    return docs.select("text").mapInArrow(find, "kind string, form string")


def in_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """The rows that ``make`` gives for the rows (as tuples) of each batch of ``df``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = make(zip(*(c.to_pylist() for c in batch.columns)))
            while part := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in part] for i, n in enumerate(names)}, wanted)

    names = [f.split()[0] for f in schema.split(", ")]
    import pyarrow as pa

    wanted = pa.schema([(n, pa.int64() if f.endswith(" long") else pa.string()) for n, f in zip(names, schema.split(", "))])
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, shape: list[str], place: str) -> DataFrame:
    """``df`` with ``rank``, from 1 on within each shape without gaps, in the order of ``place`` within each of 64 parts."""
    part = df.withColumn("part", F.pmod(place, F.lit(64)))
    before = Window.partitionBy(*shape).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.groupBy(*shape, "part").agg(F.count(F.lit(1)).alias("n")).select(*shape, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*shape, "part").orderBy(place, "form"))).join(shift, [*shape, "part"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")


def crowded(all_: DataFrame, full: DataFrame, key: bytes) -> DataFrame:
    """``kind, form, new`` for all forms of the shapes in ``full``, of which the corpus has over a quarter.

    Where there are enough forms that aren't entities, each entity gets one of these by rank in a keyed order; else the
    one that follows it in a keyed ring of the whole shape, which is an entity's at times, but one to one and never its own.
    """

    def placed(rows):
        return ((k, s, f, int.from_bytes(blake2b(f.encode(), key=key, digest_size=8, person=b"place").digest(), "big", signed=True)) for k, s, f in rows)

    def spread(rows):
        return placed((k, s, f) for k, s, one, first in rows for f in forms_of(k, one, first, 4096))

    shape, said = ["kind", "shape"], "kind string, shape string, form string, place long"
    starts = full.select(*shape, "one", F.explode(F.expr("sequence(0L, whole - 1, 4096L)")).alias("first")).repartition(*shape, "first")
    free = store(in_batches(starts, spread, said).join(all_.select("kind", "form"), ["kind", "form"], "left_anti"))
    enough = store(full.join(free.groupBy(*shape).agg(F.count(F.lit(1)).alias("free")), shape).where("free >= n").select(*shape))
    ours = all_.join(full.select(*shape), shape).select("kind", "shape", "form")
    ranked = numbered(in_batches(ours.join(enough, shape), placed, said), shape, "place").select(*shape, "form", "rank")
    given = numbered(free.join(enough, shape), shape, "place").select(*shape, F.col("form").alias("new"), "rank")
    ring = in_batches(ours.join(enough, shape, "left_anti").select("kind", "form"), lambda rows: ((k, f, surrogate(key, k, f, step=following)) for k, f in rows), "kind string, form string, new string")
    return store(ranked.join(given, [*shape, "rank"]).select("kind", "form", "new").unionByName(ring))


def collisions(docs: DataFrame, key: bytes, most_attempts: int = 1000) -> DataFrame:
    """``kind, form, new`` of the entities whose first surrogate won't do, with the one that they have instead.

    All distinct entities and their surrogates are compared as tables: of several entities with one surrogate the least
    keeps it, and a surrogate that is itself an entity of the corpus is given to none. The others try the next
    permutation until nothing collides; at least half of a shape is free then, as shapes of which the corpus has more than
    a quarter are ``crowded``. What repeats is put together map-side, so an entity of every document is no hot key.
    ``most_attempts`` without an end are an error.
    """

    def tried(rows):
        return ((*x, surrogate(key, *x)) for x in rows)

    def shaped(rows):
        return ((k, f, *shape_of(k, f)) for k, f in rows)

    said = "kind string, form string, attempt long, new string"
    all_ = store(in_batches(entities(docs).distinct(), shaped, "kind string, form string, shape string, room long"))
    full = all_.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"), F.max("room").alias("room"), F.min("form").alias("one")).where("n > room / 4")
    full = store(in_batches(full.select("kind", "shape", "one", "n"), lambda rows: ((*x, ip_place(x[2])[1] if x[0] == "ip" else place_in_shape(frame(x[0], x[2])[0])[0]) for x in rows), "kind string, shape string, one string, n long, whole long"))
    done, rest = None, all_
    if not full.isEmpty():
        done, rest = crowded(all_, full, key), all_.join(full, ["kind", "shape"], "left_anti")
    now = store(in_batches(rest.select("kind", "form", F.lit(0).cast("long")), tried, said))
    for attempt in range(most_attempts + 1):
        taken = now.groupBy("kind", "new").agg(F.min("form").alias("keeper"))
        real = all_.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
        judged = now.join(taken, ["kind", "new"]).join(real, ["kind", "new"], "left")
        judged = store(judged.withColumn("bad", (F.col("form") != F.col("keeper")) | (F.col("real").isNotNull() & (F.col("kind") != "given"))))
        bad = judged.where("bad").select("kind", "form", F.col("attempt") + 1)
        if bad.isEmpty():
            break
        if attempt == most_attempts:
            raise RuntimeError(f"surrogates still collide after {most_attempts} attempts")
        now = store(judged.where("not bad").select("kind", "form", "attempt", "new").unionByName(in_batches(bad, tried, said)))
    apart = now.where("attempt > 0").select("kind", "form", "new")
    return apart if done is None else apart.unionByName(done)


def replace_entities(docs: DataFrame, key: bytes, most_sent: int = 20_000) -> DataFrame:
    """``docs`` with ``text`` under surrogates and ``entities`` (array of kind, start, end in code points of the old text).

    Surrogates are keyed and need no table: an entity has one everywhere, in any layout, and different entities of a kind
    have different ones, since each comes from a permutation; ``collisions`` finds the rare exceptions and their surrogates. Up to ``most_sent``
    of these go to the tasks with the code; if there are more, each text meets its own by a join. Cards keep their issuer
    digit and check sum, numbers their layout and country code, addresses their shape and top-level domain, given
    names their script and gender, other names the shape and script of their letters; titles stay.

    Null text: stays null, no entities. Null in other columns, repeated rows: no matter. ``entities`` is replaced if it
    exists, other columns pass through. Empty table: empty result.
    """
    import pyarrow as pa

    from .common import plus

    apart = store(collisions(docs, key))
    few = apart.limit(most_sent + 1).collect()
    sent = {(r["kind"], r["form"]): r["new"] for r in few} if len(few) <= most_sent else {}
    source, names = docs, docs.columns
    if len(few) > most_sent:
        source = identified(docs)

        def where(batches):
            for batch in batches:
                rows = [(f, r, *x[2:]) for f, r, t in zip(*(c.to_pylist() for c in batch.columns)) for x in {y[2:]: y for y in find_entities(t or "")}.values()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], [FILE, ROW, "kind", "form"])

        own = source.select(FILE, ROW, "text").mapInArrow(where, f"{FILE} long, {ROW} long, kind string, form string").join(apart, ["kind", "form"])
        own = own.groupBy(FILE, ROW).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "kind", "form"), "new"))).alias(f"{TMP}apart"))
        source = source.join(own, [FILE, ROW], "left").select(*names, f"{TMP}apart")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for batch in batches:
            texts, spans = [], []
            at = batch.schema.names.index("text")
            maps = [dict(m or ()) for m in batch.column(batch.schema.names.index(f"{TMP}apart")).to_pylist()] if f"{TMP}apart" in batch.schema.names else None
            for i, text in enumerate(batch.column(at).to_pylist()):
                out, end, own = [], 0, []
                for a, b, what, form in find_entities(text or ""):
                    new = maps[i].get(f"{what}/{form}") if maps else sent.get((what, form))
                    out += [text[end:a], laid_out(what, text[a:b], form, known(key, what, form) if new is None else new)]
                    own.append({"kind": what, "start": a, "end": b})
                    end = b
                texts.append("".join([*out, text[end:]]) if own else text)
                spans.append(own)
            columns = {n: batch.column(j) for j, n in enumerate(batch.schema.names) if n != f"{TMP}apart"} | {"text": pa.array(texts, pa.string()), "entities": pa.array(spans, kind)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return source.mapInArrow(apply, plus(docs, "text string, entities array<struct<kind: string, start: long, end: long>>"))


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document's text under surrogates, with how many entities of each kind it had."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = replace_entities(docs, b"example key; a run in earnest brings its own")
    counts = [F.expr(f"cast(size(filter(entities, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, "text")
