"""Operator 9: PII surrogates, with DataFrame functions only.

Detected entities (e-mail, phone, card, SSN, IPv4, IPv6, IBAN, access key, password, token, person name) are replaced by surrogates drawn from
a keyed hash of the entity: the same entity gets the same surrogate in every document, and the surrogate keeps type, format, letter
case, script and, for names, gender. Collision checks keep it distinct: a surrogate that equals another one of its type, or any real
entity of its type, is drawn again until none does; after some draws it grows by a character, so that full formats (short passwords) end too.

Secrets are the values of password, token, secret and key names in any letter case, quoted (tokens of 12 characters or more) or not, of any length.

An entity's key is what identifies it whatever its format: letters and digits in lower case (e-mail, IP: with punctuation). Names are
keyed by part, so "Mrs. Anna Weber", "Ms. Anna" and "Mrs. Weber's" keep one given and one family name. A possessive 's is no part of a name.
Persons are found by a title or a listed given name before the name; other names stay.

Edge cases: null text stays null; texts without entities are returned as they are. Repeated rows get equal results, as any value of
doc_id is only carried along. Extra columns are carried along, whatever their names, except the one named by `count`, which is replaced. An
empty table gives an empty one. Texts and secrets of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, free_name, table, write_table

# Titles by gender, and given names that mark a person without a title.
TITLES = {"m": "Mr|Herr|Monsieur|Sr|Señor|Don|г-н|господин", "f": "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Sra|Srta|Señora|Doña|г-жа|госпожа", "n": "Dr|Prof"}
GIVEN = {
    "f": "Mary Anna Maria Emma Laura Julia Sarah Sophie Claire Camille Ingrid Katrin Carmen Lucia Elena Isabel Jennifer Linda Susan Margaret",
    "m": "John James Robert Michael William David Thomas Peter Hans Klaus Jürgen Wolfgang Pierre Jean Louis Antoine Carlos José Miguel Javier",
}
# Syllables of surrogate names.
SYLLABLES = {
    "latin": {"start": "Al Ber Car Dan El Fer Gal Hen Is Jor Kal Lor Mar Nor Or Per Quin Ros Sal Tam Ul Ver Wil Yor Zan Bren Cor Del Fin Gar Hol Kir", "mid": "a be ca di e fo ga hi i ka lo mi na o pe ri sa ta u va wi ya ze bra cle dri fra gli li mo ne ro", "f": "na la ra ta lia nia da sa va lina rina bella ssa tta ny nne", "m": "n r s rd ld nt ck rt x l m th ns ron ton vin", "family": "son mann berg ton ley ford well ner ini lez reau ski sen man field wood"},
    "cyrillic": {"start": "Ал Бор Вик Ген Дан Ер Зах Иг Кир Лев Мар Ник Ол Пав Рус Сер", "mid": "а е и о у ли ма не ро са та ви ге ди ко лу", "f": "на ла ра лия нея рина ша та", "m": "н р й м в т с л", "family_f": "нова лева рина ская това кова шина гина", "family_m": "нов лев рин ский тов ков шин гин"},
}

# A name: letters, inner apostrophes and hyphens, but no possessive 's.
_PART = r"\p{Lu}(?:\p{L}|['’](?![sS](?!\p{L}))(?=\p{L}))++"
_NAME = rf"{_PART}(?:-{_PART})?+"
_EDGE = r"(?<![\p{L}\p{N}_])"
_KEY_EDGE = r"(?<![\p{L}\p{N}])"
_PATTERNS = {
    # A domain name has 127 labels at most.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "password": r"(?=[Pp])" + _KEY_EDGE + r"(?i:password|passwd|pwd)[\"']? *[=:] *(?:[\"'][^\"'\n]{4,}[\"']|[^\s\"',;]{3,}[^\s\"',;.])",
    # Unquoted, an access key is left to its own pattern, and a value that goes on with a bracket is a call.
    "token": r"(?=[TtSsAa])" + _KEY_EDGE + r"(?i:token|secret|api[_-]?key|access[_-]?key)[\"']? *[=:] *(?:[\"'][A-Za-z0-9+/_=.-]{12,}+[\"']|(?!(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z]))[A-Za-z0-9+/_=-]{12,}+(?:\.[A-Za-z0-9+/_=-]++)*+(?![(\[]))",
    "access_key": _EDGE + r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|" + _EDGE + r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{N}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*+)?+::(?:[0-9A-Fa-f]{1,4}:)*+[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}:]|\.\d)",
    "card": r"(?<![\p{N}.+-])(?:[46]\d{3}(?:[ -]?\d{4}){3}[ -]?\d{3}|(?:[3-6]\d{3}|2(?:2(?:2[1-9]|[3-9]\d)|[3-6]\d\d|7(?:[01]\d|20)))(?:[ -]?\d{4}){3}|3[47]\d\d[ -]?\d{6}[ -]?\d{5}|3(?:0[0-5]|[689]\d)\d[ -]?\d{6}[ -]?\d{4})(?![\p{N}]|[.-]\d)",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}]|-\d)",
    "phone": r"(?<![\p{N}+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\p{N})|(?<![\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\p{N})|(?<![\p{N}.-])\d{3}([.-])\d{3}\1\d{4}(?![\p{N}]|[.-]\d)".replace(r"([.-])\d{3}\1", r"[.-]\d{3}[.-]"),
    "name": _EDGE + r"(?:(?:" + "|".join(TITLES.values()) + r")\.? |(?=(?:" + "|".join(" ".join(GIVEN.values()).split()) + r") ))" + _NAME + r"(?: " + _NAME + r"){0,2}",
}
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(e: str) -> str:
    """SQL: the type of the entity e, which matched PATTERN as a whole."""
    return "CASE " + " ".join(f"WHEN {e} RLIKE {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in _PATTERNS.items()) + " ELSE 'name' END"


def _pick(words: str, i: int) -> str:
    """SQL: one of the words by part i of the hash."""
    w = words.split()
    return f"element_at(array({', '.join(map(_sql, w))}), 1 + cast(conv(substr(h, {1 + 6 * i}, 6), 16, 10) % {len(w)} as int))"


def _parts(e: str) -> str:
    """SQL: array of (kind, prefix that stays, raw part) of the entity."""
    title = f"regexp_extract({e}, {_sql('^(?:' + '|'.join(TITLES.values()) + r')\.? ')}, 0)"
    bare = f"substr({e}, length({title}) + 1)"
    gender = f"CASE WHEN {title} RLIKE {_sql('^(?:' + TITLES['m'] + r')\.? $')} THEN 'm' WHEN {title} RLIKE {_sql('^(?:' + TITLES['f'] + r')\.? $')} THEN 'f' WHEN {bare} RLIKE {_sql('^(?:' + GIVEN['f'].replace(' ', '|') + ')(?: |$)')} THEN 'f' WHEN {bare} RLIKE {_sql('^(?:' + GIVEN['m'].replace(' ', '|') + ')(?: |$)')} THEN 'm' ELSE 'n' END"
    names = f"split({bare}, ' ')"
    listed = f"w IN ({', '.join(map(_sql, ' '.join(GIVEN.values()).split()))})"
    # The last part is the family name, but for a listed given name that stands alone behind a title.
    family = f"(j = size({names}) - 1 and not (j = 0 and {listed}))"
    script = "if(w RLIKE '\\\\p{IsCyrillic}', 'cyrillic', 'latin')"
    name = (
        f"transform({names}, (w, j) -> named_struct('kind', if({family}, concat_ws('_', 'family', {script}, if({script} = 'latin', 'n', {gender})), concat_ws('_', 'given', {script}, {gender})), "
        f"'prefix', if(j = 0, {title}, ' '), 'raw', w, 'suffix', ''))"
    )
    lead = f"regexp_extract({e}, {_sql('^[A-Za-z_-]+[' + chr(34) + chr(39) + ']? *[=:] *[' + chr(34) + chr(39) + ']?')}, 0)"
    quote = f"regexp_extract({e}, {_sql('[' + chr(34) + chr(39) + ']$')}, 0)"
    secret = f"array(named_struct('kind', kind, 'prefix', {lead}, 'raw', substr({e}, length({lead}) + 1, length({e}) - length({lead}) - length({quote})), 'suffix', {quote}))"
    return f"CASE WHEN kind = 'name' THEN {name} WHEN kind IN ('password', 'token') THEN {secret} ELSE array(named_struct('kind', kind, 'prefix', '', 'raw', {e}, 'suffix', '')) END"


KEY_SQL = "CASE WHEN kind IN ('email', 'ipv6') THEN lower(raw) WHEN kind IN ('ip', 'password', 'token', 'access_key') THEN raw WHEN kind RLIKE '^(family|given)' THEN lower(raw) ELSE lower(regexp_replace(raw, '[^A-Za-z0-9]', '')) END"


def _payload(secret: str) -> Column:
    """The surrogate for (kind, key, attempt), in the key's own form; h is its keyed hash."""
    n = "cast(conv(substr(sha2(concat_ws('|', {s}, kind, {of}, attempt, i), 256), 1, 8), 16, 10) as bigint)".replace("{s}", _sql(secret))
    own, domain = n.replace("{of}", "key"), n.replace("{of}", "substring_index(key, '@', -1)")

    def char(v: str, letters: str = "'abcdefghijklmnopqrstuvwxyz'", count: int = 26) -> str:
        return f"CASE WHEN c RLIKE '^[0-9]$' THEN cast({v} % 10 as string) WHEN c RLIKE '^[a-z]$' THEN substr({letters}, cast(1 + {v} % {count} as int), 1) WHEN c RLIKE '^[A-Z]$' THEN upper(substr({letters}, cast(1 + {v} % {count} as int), 1)) ELSE c END"

    chars = "split(key, '')"
    shape = f"array_join(transform({chars}, (c, i) -> {char(own)}), '')"
    hexed = f"array_join(transform({chars}, (c, i) -> {char(own, _sql('abcdef'), 6)}), '')"
    host = "length(key) - length(substring_index(key, '.', -1))"
    email = f"array_join(transform({chars}, (c, i) -> CASE WHEN i >= {host} THEN c WHEN i > instr(key, '@') - 1 THEN {char(domain)} ELSE {char(own)} END), '')"
    ip = f"array_join(transform(split(key, '[.]'), (c, i) -> cast(1 + {own} % if(i = 0, 223, 254) as string)), '.')"
    # The first group stays, as it tells what kind of address it is; the others keep their length and begin with a digit that is not 0.
    group = f"conv(cast(1 + {own} % 15 as string), 10, 16)"
    ipv6 = f"array_join(transform({chars}, (c, i) -> CASE WHEN c = ':' OR i < instr(key, ':') THEN c ELSE lower({group}) END), '')"
    digits = f"transform({chars}, (c, i) -> cast(CASE WHEN i = 0 OR i = 1 AND kind = 'card' AND length(key) IN (14, 15) THEN cast(c as bigint) WHEN i = 1 AND kind = 'card' AND substr(key, 1, 1) = '2' THEN 3 + {own} % 4 WHEN i = 1 THEN 2 + {own} % 8 ELSE {own} % 10 END as int))"
    total = "aggregate({d}, named_struct('s', 0, 'n', {first}), (a, x) -> named_struct('s', a.s + if(a.n % 2 = 1, if(x > 4, 2 * x - 9, 2 * x), x), 'n', a.n + 1)).s"
    given = f"transform({chars}, (c, i) -> cast(c as int))"
    # The sum over all digits, the last one counted once; what the last digit must be for the same remainder as in the original.
    luhn = f"transform(array({digits}), d -> concat(array_join(slice(d, 1, size(d) - 1), ''), cast(pmod({total.format(d=given, first='size(d) % 2 + 1')} - {total.format(d='slice(d, 1, size(d) - 1)', first='size(d) % 2 + 1')}, 10) as string)))[0]"
    phone = f"array_join({digits}, '')"
    body = f"array_join(transform({chars}, (c, i) -> CASE WHEN i < 2 THEN c ELSE {char(own)} END), '')"
    mod97 = "aggregate(split(concat(substr(b, 5), substr(b, 1, 2), '00'), ''), 0, (a, c) -> if(c RLIKE '^[0-9]$', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 87) % 97))"
    iban = f"transform(array({body}), b -> concat(substr(b, 1, 2), lpad(cast(98 - {mod97} as string), 2, '0'), substr(b, 5)))[0]"
    access = f"array_join(transform({chars}, (c, i) -> CASE WHEN i < 4 THEN c ELSE {char(own)} END), '')"
    lat, cyr = SYLLABLES["latin"], SYLLABLES["cyrillic"]
    h = f"sha2(concat_ws('|', {_sql(secret)}, kind, key, attempt), 256)"

    def name(s: dict[str, str], end: str) -> str:
        return f"concat({_pick(s['start'], 0)}, {_pick(s['mid'], 1)}, {_pick(s['mid'], 2)}, if(attempt > 3, {_pick(s['mid'], 4)}, ''), if(attempt > 6, {_pick(s['mid'], 5)}, ''), {end})"

    ends = {
        "given_latin_f": name(lat, _pick(lat["f"], 3)), "given_latin_m": name(lat, _pick(lat["m"], 3)), "given_latin_n": name(lat, _pick(lat["f"] + " " + lat["m"], 3)), "family_latin_n": name(lat, _pick(lat["family"], 3)),
        "given_cyrillic_f": name(cyr, _pick(cyr["f"], 3)), "given_cyrillic_m": name(cyr, _pick(cyr["m"], 3)), "given_cyrillic_n": name(cyr, _pick(cyr["m"], 3)),
        "family_cyrillic_f": name(cyr, _pick(cyr["family_f"], 3)), "family_cyrillic_m": name(cyr, _pick(cyr["family_m"], 3)), "family_cyrillic_n": name(cyr, _pick(cyr["family_m"], 3)),
    }
    names = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ends.items()).replace("substr(h,", f"substr({h},")
    # From the fourth draw on a secret, from the sixteenth on anything else grows, a character more every so many draws.
    step = "if(kind IN ('password', 'token'), 4, 16)"
    grown = f"if(attempt < {step}, '', array_join(transform(sequence(1, cast(attempt / {step} as int)), (c, i) -> if(key RLIKE '^[0-9]+$', cast({own.replace('attempt, i)', 'attempt, i, -1)')} % 10 as string), substr('abcdefghijklmnopqrstuvwxyz', cast(1 + {own.replace('attempt, i)', 'attempt, i, -1)')} % 26 as int), 1))), ''))"
    return F.expr(
        f"concat(CASE kind WHEN 'email' THEN {email} WHEN 'ipv6' THEN {ipv6} WHEN 'ip' THEN {ip} WHEN 'card' THEN {luhn} WHEN 'phone' THEN {phone} WHEN 'iban' THEN {iban} WHEN 'access_key' THEN {access} {names} "
        f"ELSE if(key RLIKE '^[0-9a-f]+$', {hexed}, {shape}) END, {grown})"
    )


# The payload in the format of the mention: separators and letter case stay.
LAYOUT_SQL = (
    "CASE WHEN kind IN ('ip', 'password', 'token', 'access_key') THEN payload "
    "WHEN kind RLIKE '^(family|given)' THEN if(raw = upper(raw) and length(raw) > 1, upper(payload), payload) "
    "WHEN kind IN ('email', 'ipv6') THEN array_join(zip_with(split(payload, ''), split(raw, ''), (p, c) -> if(c RLIKE '^[A-Z]$', upper(p), p)), '') "
    "ELSE aggregate(split(raw, ''), named_struct('t', '', 'n', 1), (a, c) -> if(c RLIKE '^[A-Za-z0-9]$', named_struct('t', concat(a.t, if(c RLIKE '^[A-Z]$', upper(substr(payload, a.n, 1)), substr(payload, a.n, 1))), 'n', a.n + 1), named_struct('t', concat(a.t, c), 'n', a.n)), a -> concat(a.t, substr(payload, a.n))) END"
)


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """Distinct (kind, key) -> (kind, key, payload), payloads distinct within a kind and none equal to a key of the kind.

    All keys draw at once; those whose draw is taken or lost to a smaller key draw again, until none is left.
    """
    keys = entities.select("kind", "key")
    real = keys.withColumnRenamed("key", "payload")
    todo, done, attempt = keys.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = write_table(todo.withColumn("payload", _payload(secret)))
        taken = real if done is None else real.unionByName(done.select("kind", "payload"))
        free = drawn.join(taken.distinct(), ["kind", "payload"], "left_anti")
        wins = free.groupBy("kind", "payload").agg(F.min("key").alias("key")).select("kind", "key", "payload")
        after = write_table(wins if done is None else done.unionByName(wins))
        attempt += 1
        rest = write_table(drawn.select("kind", "key").join(after.select("kind", "key"), ["kind", "key"], "left_anti").withColumn("attempt", F.lit(attempt)))
        for old in (drawn, done, todo):
            if old is not None:
                drop_table(old)
        done, todo = after, rest
        if rest.isEmpty():
            drop_table(rest)
            return done


def surrogates(docs: DataFrame, secret: str, count: str = "n_entities") -> DataFrame:
    """docs (text, ...) -> the same columns with surrogates in text, and the long column `count`. secret: key of the hash, to be kept.

    The text is searched once; only texts with entities are touched again.
    """
    docs = docs.drop(count)
    found, uid = free_name(docs, "entities"), "uid"
    marked = write_table(docs.withColumn(found, F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hits = marked.where(F.size(found) > 0).select(own.alias("doc"), F.split("text", PATTERN, -1).alias("pieces"), F.col(found).alias("entities"))
    hits = write_table(hits.withColumn(uid, F.monotonically_increasing_id()))
    mentions = hits.select(uid, "pieces", F.posexplode("entities").alias("pos", "e")).withColumn("kind", F.expr(_kind("e")))
    parts = mentions.select(uid, "pos", F.element_at("pieces", F.col("pos") + 1).alias("before"), F.posexplode(F.expr(_parts("e"))).alias("part", "p")).select(uid, "pos", "part", F.when(F.col("part") == 0, F.col("before")).otherwise("").alias("before"), "p.*")
    parts = write_table(parts.withColumn("key", F.expr(KEY_SQL)))
    known = assign(write_table(parts.select("kind", "key").distinct()), secret)
    laid = parts.join(known, ["kind", "key"]).select(uid, F.struct("pos", "part", F.concat("before", "prefix", F.expr(LAYOUT_SQL), "suffix").alias("t")).alias("x"))
    texts = laid.groupBy(uid).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    done = hits.join(texts, uid).select("doc", F.concat(F.array_join(F.transform("xs", lambda x: x["t"]), ""), F.element_at("pieces", -1)).alias("new"), F.size("entities").cast("long").alias("n"))
    out = done.select(*[(F.col("new") if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns], F.col("n").alias(count))
    return marked.where(F.size(found) == 0).drop(found).withColumn(count, F.lit(0).cast("long")).unionByName(out)


# The key of the query and of the pipeline stage where the session names none; a corpus that leaves the house needs one of its own.
KEY_CONF, TEST_KEY = "spark.linkora.surrogate.key", "a key for tests"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents"), spark.conf.get(KEY_CONF, TEST_KEY)).select("doc_id", "text", "n_entities")


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with surrogates for its entities.

    The columns are those of docs, whatever their names; n_chars, if there, is counted anew. Nulls, repeated rows and an empty table are as in `surrogates`.
    """
    out = surrogates(docs, spark.conf.get(KEY_CONF, TEST_KEY), count=free_name(docs, "entities_found"))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
