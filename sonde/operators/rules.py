"""Rules as data: weighted patterns, labels, findings, tiers, verdicts, folder predicates and family scores."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sonde.functions.text import glob_pattern

#: Signals of the prefilter as (name, weight, pattern). A message is adjudicated from three points upwards.
SIGNALS = (
    ("deface_banner", 3, r"(?i)(?:\b(?:hacked|h4cked|0wned|owned|pwned|pwn3d|defaced|rooted|breached)\s+by\b|\bgreet[sz]\b|\bmass[\s-]?deface\b|\bdeface(?:d|ment)?\s+by\b|\bhacked\s+list\b)"),
    ("onion_url", 3, r"(?i)\b[a-z2-7]{16,56}\.onion\b"),
    ("cred_combo", 3, r"(?i)[\w.+-]{1,64}@[\w-]{1,63}\.[a-z]{2,24}:\S{3,64}"),
    ("compromise_confirmed", 3, r"(?i)(?:\bshell\s+uploaded\b|\buploaded\s+(?:a\s+)?shell\b|\bbackdoor\s+(?:installed|deployed|planted|up)\b|\bgot\s+(?:root|shell)\b|\baccess\s+(?:gained|confirmed|granted)\b|\bsuccessfully\s+(?:hacked|breached|compromised|defaced|pwned|breaked)\b)"),
    ("check_host", 3, r"(?i)\bcheck-host\.net/check-report/\w+"),
    ("ddos_command", 3, r"(?im)(?:^|\s)/(?:attack|flood|ddos|dstat|stress|hit|scan)\s+(?:https?://|\d{1,3}(?:\.\d{1,3}){3}|[a-z0-9-]+\.[a-z]{2,})\S*"),
    ("crew_tag_cluster", 2, r"(?i)#[a-z0-9_]{2,30}\b[\s,·|]{0,8}#[a-z0-9_]{2,30}\b"),
    ("leak_label", 2, r"(?i)\b(?:database|base\s+de\s+datos|db\s?dump|dbs|full\s?dump|leaked|data\s?breach|breach|registros|combo\s?list)\b"),
    ("cloud_pass", 2, r"(?i)\bpass\w*\s*[-:=]\s*(?:@|t\.me/)[a-z0-9_]{3,32}\b"),
    ("cred_label", 2, r"(?i)\b(?:user(?:name)?|usuario|login|логин)\b\s*[:=].{0,60}?\b(?:pw|pass(?:word)?|пароль|clave)\b\s*[:=]"),
    ("target_dump_file", 2, r"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\.(?:zip|rar|7z|sql|tar\.gz)\b"),
    ("leak_host", 2, r"(?i)\b(?:pastebin\.com|ghostbin\.\w+|anonfiles\.\w+|mega\.nz|gofile\.io|privatebin\.\w+|dpaste\.\w+|transfer\.sh|file\.io|breachforums\.\w+|breached\.su|darkforums\.\w+|leakbase\.\w+|nulled\.\w+|cracked\.\w+|exposed\.vc|biteblob\.\w+)\b"),
    ("hash_list", 2, r"(?i)\b[a-f0-9]{32,64}\b(?:[\s,;|]+[a-f0-9]{32,64}\b){2,}"),
    ("sale_marker", 2, r"(?i)(?:\b(?:wts|wtb|for\s?sale|selling|sold|vendo|продам)\b|-\s?sold\s?-|\bprice\s*[:=])"),
    ("access_material", 2, r"(?i)\b(?:webshell|web\s?shell|rce|reverse\s?shell|shell\s?access|rdp|smtp|cpanel|(?:root|admin|full)\s?access|c99|r57|wso)\b"),
    (
        "tool_sale",
        2,
        r"(?i)(?:booter|stress?er|wormgpt|scam\s?page|scampage"
        r"|\bkeylogger\b|\bbotnet\b|\botp\s?bot\b|\bstealer\s?(?:builder|source)\b|\bloader\s?builder\b"
        r"|\bcrypter\b[^\n]{0,40}?\b(?:sell\w*|for\s?sale|fud|cracked|price|rent|sub\w*|stock|promo|interested|offer\w*)\b"
        r"|\b(?:sell\w*|for\s?sale|fud|cracked|price|stock|promo|interested|offer\w*)\b[^\n]{0,40}?\bcrypter\b"
        r"|\b(?:dd[o0]s|dstat|l7|l4|layer\s?[47])\b[^\n]{0,45}?\b(?:script|setup|service|panel|method|rps|plan|subscription|for\s?sale|selling|sell|buy|purchase|rent|cloudflare)\b"
        r"|\b(?:for\s?sale|selling|sell|buy|purchase|updated)\b[^\n]{0,45}?\b(?:dd[o0]s|l7|l4)\b"
        r"|\b(?:selling|for\s?sale|jual|rent|buy)\b[^\n]{0,45}?\b(?:script|software|tool|method|checker|scanner|builder|source|course|config)\b"
        r"|\bservice\s?drop\b|\bcnc\s?panel\b|\bwallet\s?scanner\b|\baccount\s?recovery\b"
        r"|\bbuild\s?your\s?own\b[^\n]{0,30}?\b(?:cnc|api|panel|setup|booter|stress?er)\b)",
    ),
    (
        "telecom_abuse",
        2,
        r"(?i)(?:\b(?:cid|caller[\s-]?id)\s?spoof\w*|\bspoof(?:ed|ing)?\b[^\n]{0,20}?\b(?:call|caller|cid|number)\b"
        r"|\bunlimited\s+spoofing\b|\bspoofing\s+power\b"
        r"|\b(?:voip|sip)\b[^\n]{0,20}?\b(?:trunk|setup|route|provider|gateway|panel|dialer|dial|access)\w*"
        r"|\bbulk\s?sms\b|\bsms\s?(?:sender|blast|route|gateway|marketing|deliver\w*|spam)\b"
        r"|\bmass\s?(?:sms|text)\b|\bsender\s?id\b|\bsendgrid\b|\bweb\s?mailer\b|\bmass\s?mail\w*"
        r"|\bsmtp\s?(?:sender|blast|cracked|combo|inbox|spam)\b)",
    ),
    ("multi_target", 2, r"(?is)(?:(?:https?://\S+\s+){2}https?://\S+)|(?:(?:(?:\d{1,3}\.){3}\d{1,3})\D*){3}"),
    (
        "stealer_logs",
        2,
        r"(?i)(?:\b(?:stealer|redline|lumma|raccoon|vidar|risepro|stealc|meta\s?stealer)\b"
        r"|\bl0g[s$]|\bfresh\s?(?:logs?|material|clouds?)\b|\bcloud\s?logs?\b|\buhq\b|\bu\.?l\.?p\b|\b\d[\d.,]*\s?lines\b"
        r"|(?is:\blogs?\b.{0,30}?\b\d[\d,]*\s*(?:pcs|pieces|pzs)\b)|\burl[:\s|]+(?:log|user|mail)[:\s|]+pass\b)",
    ),
    ("pii_schema", 2, r"(?i)(?:\b(?:firstname|lastname|middlename|passport|passexpiry|nationality|dob|emailaddress|primary_phone|second_phone|zip_code|marital|jobtitle|national_id|ssn|cardnumber|cvv)\b[\s,|]+){3,}"),
    ("session_id", 2, r"(?i)\b05[a-f0-9]{64}\b"),
    ("institutional_target", 2, r"(?i)\b[a-z0-9.-]+\.(?:gov|mil|int|edu|(?:gov|gob|gouv|go|mil|ac|edu)\.[a-z]{2})\b"),
    ("cve", 1, r"(?i)\bCVE-\d{4}-\d{4,7}\b"),
    ("btc_addr", 1, r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("eth_addr", 1, r"(?i)\b0x[a-f0-9]{40}\b"),
    ("ipv4", 1, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("tg_target", 1, r"(?i)(?:\bt\.me/|@)[a-z0-9_]{4,32}\b"),
    ("record_count", 1, r"(?i)\b\d[\d.,]*\s?(?:kk|k|m|mil|mill?ion|millones|млн|records|rows|lines|entries)\b"),
    ("dm_contact", 1, r"(?i)\bdm\s+@?[a-z0-9_]{3,32}\b"),
)
#: What a signal says about a message.
SIGNAL_LABELS = {
    "deface_banner": "defacement",
    "ddos_command": "ddos_attack",
    "check_host": "ddos_attack",
    "compromise_confirmed": "intrusion",
    "multi_target": "ddos_attack",
    "leak_host": "breach_dump",
    "leak_label": "breach_dump",
    "target_dump_file": "breach_dump",
    "pii_schema": "breach_dump",
    "hash_list": "credentials",
    "cred_combo": "credentials",
    "cred_label": "credentials",
    "onion_url": "breach_dump",
    "stealer_logs": "stealer_logs",
    "cloud_pass": "stealer_logs",
    "access_material": "iab_corporate",
    "tool_sale": "crimeware_tooling",
    "telecom_abuse": "telecom_abuse",
}
#: One of these, in lower case, stands in every text on which the pattern fires; a look for them is far cheaper than the
#: pattern. Signals that are not named have no such parts.
NEEDS = {
    "deface_banner": ("ed", "pwn3d", "greet", "deface"),
    "onion_url": (".onion",),
    "cred_combo": ("@",),
    "compromise_confirmed": ("shell", "backdoor", "got", "access", "success"),
    "check_host": ("check-host.net",),
    "ddos_command": ("/attack", "/flood", "/ddos", "/dstat", "/stress", "/hit", "/scan"),
    "crew_tag_cluster": ("#",),
    "leak_label": ("base", "dump", "dbs", "leak", "breach", "registros", "combo"),
    "cloud_pass": ("pass",),
    "cred_label": ("pw", "pass", "пароль", "clave"),
    "target_dump_file": (".zip", ".rar", ".7z", ".sql", ".tar.gz"),
    "leak_host": (".",),
    "sale_marker": ("wts", "wtb", "sale", "selling", "sold", "vendo", "продам", "price"),
    "access_material": ("shell", "rce", "rdp", "smtp", "cpanel", "access", "c99", "r57", "wso"),
    "telecom_abuse": ("spoof", "voip", "sip", "sms", "mass", "sender", "sendgrid", "mail", "smtp"),
    "pii_schema": ("name", "pass", "national", "dob", "email", "phone", "zip_code", "marital", "jobtitle", "ssn", "cardnumber", "cvv"),
    "session_id": ("05",),
    "institutional_target": (".gov", ".mil", ".int", ".edu", ".gob", ".gouv", ".go", ".ac"),
    "cve": ("cve-",),
    "eth_addr": ("0x",),
    "ipv4": (".",),
    "tg_target": ("t.me/", "@"),
    "dm_contact": ("dm",),
}
#: Costly patterns in parts whose alternation is the pattern: of each group of literals one stands in every text on which the part fires.
PARTS = {
    "tool_sale": [
        ([("booter", "streser", "stresser", "wormgpt", "scam")], r"booter|stress?er|wormgpt|scam\s?page|scampage"),
        ([("keylogger", "botnet", "otp", "stealer", "loader")], r"\bkeylogger\b|\bbotnet\b|\botp\s?bot\b|\bstealer\s?(?:builder|source)\b|\bloader\s?builder\b"),
        ([("crypter",)], r"\bcrypter\b[^\n]{0,40}?\b(?:sell\w*|for\s?sale|fud|cracked|price|rent|sub\w*|stock|promo|interested|offer\w*)\b"),
        ([("crypter",)], r"\b(?:sell\w*|for\s?sale|fud|cracked|price|stock|promo|interested|offer\w*)\b[^\n]{0,40}?\bcrypter\b"),
        ([("ddos", "dd0s", "dstat", "l7", "l4", "layer")], r"\b(?:dd[o0]s|dstat|l7|l4|layer\s?[47])\b[^\n]{0,45}?\b(?:script|setup|service|panel|method|rps|plan|subscription|for\s?sale|selling|sell|buy|purchase|rent|cloudflare)\b"),
        ([("ddos", "dd0s", "l7", "l4")], r"\b(?:for\s?sale|selling|sell|buy|purchase|updated)\b[^\n]{0,45}?\b(?:dd[o0]s|l7|l4)\b"),
        ([("selling", "sale", "jual", "rent", "buy"), ("script", "software", "tool", "method", "checker", "scanner", "builder", "source", "course", "config")], r"\b(?:selling|for\s?sale|jual|rent|buy)\b[^\n]{0,45}?\b(?:script|software|tool|method|checker|scanner|builder|source|course|config)\b"),
        ([("drop", "panel", "scanner", "recovery")], r"\bservice\s?drop\b|\bcnc\s?panel\b|\bwallet\s?scanner\b|\baccount\s?recovery\b"),
        ([("build",), ("own",), ("cnc", "api", "panel", "setup", "booter", "stres")], r"\bbuild\s?your\s?own\b[^\n]{0,30}?\b(?:cnc|api|panel|setup|booter|stress?er)\b"),
    ],
    "stealer_logs": [
        ([("stealer", "redline", "lumma", "raccoon", "vidar", "risepro", "stealc", "meta")], r"\b(?:stealer|redline|lumma|raccoon|vidar|risepro|stealc|meta\s?stealer)\b"),
        ([("l0g", "fresh", "cloud", "uhq")], r"\bl0g[s$]|\bfresh\s?(?:logs?|material|clouds?)\b|\bcloud\s?logs?\b|\buhq\b"),
        ([("ulp", "u.lp", "ul.p", "u.l.p")], r"\bu\.?l\.?p\b"),
        ([("lines",)], r"\b\d[\d.,]*\s?lines\b"),
        ([("log",), ("pcs", "pieces", "pzs")], r"(?is:\blogs?\b.{0,30}?\b\d[\d,]*\s*(?:pcs|pieces|pzs)\b)"),
        ([("url",), ("pass",)], r"\burl[:\s|]+(?:log|user|mail)[:\s|]+pass\b"),
    ],
    "multi_target": [([("://",)], r"(?:(?:https?://\S+\s+){2}https?://\S+)"), ([(".",)], r"(?:(?:(?:\d{1,3}\.){3}\d{1,3})\D*){3}")],
}
ADJUDICATE = 3


def _compiled(signals: tuple) -> list[list[tuple]]:
    """For each signal its parts (literals, pattern); \\w, \\b, \\s and case are those of ASCII, as in SQL."""
    parts = [PARTS.get(n) or [([NEEDS[n]] if n in NEEDS else [], p)] for n, _, p in signals]
    flags = re.compile(r"\A\(\?[a-z]+\)")
    heads = [m.group() if (m := flags.match(p)) else "" for _, _, p in signals]
    return [[(needs, re.compile(p if flags.match(p) else head + p, re.ASCII)) for needs, p in part] for head, part in zip(heads, parts, strict=True)]


def fired_bits(texts: list[str | None], signals: tuple = SIGNALS) -> list[int]:
    """A whole number for each text: bit i is set if the i-th signal's pattern occurs. A text's literals are looked for before its patterns."""
    compiled, out = _compiled(tuple(signals)), []
    for text in texts:
        bits, low = 0, (text or "").lower()
        seen: dict[str, bool] = {}

        def has(part: str, low=low, seen=seen) -> bool:
            if part not in seen:
                seen[part] = part in low
            return seen[part]

        for i, parts in enumerate(compiled if low else ()):
            if any(all(any(map(has, group)) for group in needs) and pattern.search(text) for needs, pattern in parts):
                bits |= 1 << i
        out.append(bits)
    return out


def _fired(text: Column, signals: tuple) -> Column:
    @F.pandas_udf(T.LongType())
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(fired_bits(texts.tolist(), signals), dtype="int64")

    return bits(text)


def weighted(text: Column, signals=SIGNALS) -> tuple[Column, Column]:
    """(sum of the weights of the signals that fire, their names in order); text with look-alike letters folded.

    All patterns are tried on a text in one pass of a batch: as expressions they would each fold and lower it anew.
    """
    if len(signals) > 63:
        raise ValueError("at most 63 signals")
    fired = _fired(text, tuple(signals))
    hits = [(n, w, fired.bitwiseAND(F.lit(1 << i)) != 0) for i, (n, w, _) in enumerate(signals)]
    score = reduce(lambda a, b: a + b, [F.when(hit, w).otherwise(0) for _, w, hit in hits])
    return score, F.array_compact(F.array(*[F.when(hit, n) for n, _, hit in hits]))


def signal_labels(names: Column) -> Column:
    """The distinct labels of fired signals, in order of the alphabet."""
    table = F.create_map(*[F.lit(x) for pair in SIGNAL_LABELS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(names, lambda n: F.try_element_at(table, n)))))


def platt(logit: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(logit * a + b)))


def findings(docs: DataFrame, key: str, text: str, rules: list[tuple[str, int, str]]) -> DataFrame:
    """(key, rule, rank, n): how often each rule's pattern occurs in each text."""
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(rank).alias("rank"), F.regexp_count(text, F.lit(p)).alias("n")) for n, rank, p in rules])
    return docs.select(key, F.inline(found)).where("n > 0")


def floors(found: DataFrame, key: str) -> DataFrame:
    """(key, tier): the highest rank among a text's findings."""
    return found.groupBy(key).agg(F.max("rank").alias("tier"))


def country_verdict(signals: DataFrame, key: str, cap: int = 3, least: float = 10.0, share: float = 0.6) -> DataFrame:
    """(key, country, verdict) of weighted (key, iso, kind, weight) signals.

    A kind counts at most `cap` times for a country; the leader needs `least` points and `share` of all to be resolved.
    """
    order = W.partitionBy(key, "iso", "kind").orderBy(F.desc("weight"))
    capped = signals.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= cap)
    points = capped.groupBy(key, "iso").agg(F.sum("weight").alias("points"))
    lead = points.groupBy(key).agg(F.sum("points").alias("all"), F.max("points").alias("most"), F.min_by("iso", F.struct((-F.col("points")).alias("p"), "iso")).alias("leader"))
    firm = (F.col("most") >= least) & (F.col("most") >= share * F.col("all"))
    verdict = F.when(firm, "resolved").when(F.col("most") >= least, "mixed").otherwise("unknown")
    return lead.select(key, F.when(firm, F.col("leader")).alias("country"), verdict.alias("verdict"))


def mod97(digits: Column) -> Column:
    """The remainder of a decimal string by 97, digit by digit, so of any length."""
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, d: (a * 10 + F.coalesce(d.try_cast("int"), F.lit(0))) % 97)


def iban_ok(c: Column) -> Column:
    """Letters become two digits, the first four characters go to the end, and the remainder by 97 is 1."""
    turned = F.upper(F.concat(F.substring(c, 5, 100), F.substring(c, 1, 4)))
    spelled = F.array_join(F.transform(F.split(turned, ""), lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch)), "")
    return c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$") & (mod97(spelled) == 1)


def rut_check(number: Column) -> Column:
    """The mod-11 check character of a national number: digits from the right, weighted 2 to 7 in turn."""
    digits = F.split(F.reverse(number.cast("string")), "")
    total = F.aggregate(F.transform(digits, lambda d, i: d.cast("int") * (i % 6 + 2)), F.lit(0), lambda a, b: a + b)
    left = 11 - total % 11
    return F.when(left == 11, "0").when(left == 10, "K").otherwise(left.cast("string"))


Predicate = tuple


def folder(paths: Column, tree: Predicate) -> Column:
    """A predicate tree over a list of paths: and, or, xor (odd parity), not, at_least, exactly, at_most, path, glob."""
    kind, *rest = tree
    if kind == "path":
        return F.array_contains(paths, rest[0])
    if kind == "glob":
        return F.exists(paths, lambda p: F.regexp_like(p, F.lit(glob_pattern(rest[0]))))
    if kind == "not":
        return ~folder(paths, rest[0])
    count = lambda trees: reduce(lambda a, b: a + b, [folder(paths, t).cast("int") for t in trees])
    if kind in ("at_least", "exactly", "at_most"):
        n, hits = rest[0], count(rest[1:])
        return {"at_least": hits >= n, "exactly": hits == n, "at_most": hits <= n}[kind]
    if kind == "xor":
        return count(rest) % 2 == 1
    if kind in ("and", "or"):
        return reduce(lambda a, b: a & b if kind == "and" else a | b, [folder(paths, t) for t in rest])
    raise ValueError(f"unknown predicate {kind}")


def family_scores(evidence: DataFrame, key: str, signals: DataFrame, floor: float = 0.35) -> DataFrame:
    """(key, family, confidence, evidence): the best family of (key, feature) rows by (family, feature, weight) signals.

    Confidence is the sum of the weights that fired over the sum of all positive ones plus two; negative weights speak
    against a family. Order: confidence, evidence, family name.
    """
    most = signals.where("weight > 0").groupBy("family").agg(F.sum("weight").alias("most"))
    fired = evidence.distinct().join(signals, "feature").groupBy(key, "family").agg(F.sum("weight").alias("sum"), F.count("*").alias("evidence"))
    scored = fired.join(most, "family").withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.col("sum") / (F.col("most") + 2)), 4))
    best = W.partitionBy(key).orderBy(F.desc("confidence"), F.desc("evidence"), "family")
    return scored.withColumn("rn", F.row_number().over(best)).where((F.col("rn") == 1) & (F.col("confidence") >= floor)).select(key, "family", "confidence", "evidence")


def _outside(names: list[str]):
    return lambda k, v: ~k.isin(*names)


def run_rules(records: DataFrame, key: str, path: str, text: str, rules: list[dict]) -> DataFrame:
    """(key, family, fields) by priority: of matching container rules the highest priority names the family, content rules merge.

    A rule: id, layer (container or content), family (None: any), priority, path_glob, pattern with groups, names. Content
    rules apply in ascending priority, later ones overwriting fields.
    """
    hit = lambda r: F.regexp_like(path, F.lit(glob_pattern(r["path_glob"]))) & F.regexp_like(text, F.lit(r["pattern"]))
    containers = sorted((r for r in rules if r["layer"] == "container"), key=lambda r: (-r["priority"], r["id"]))
    family = F.coalesce(*[F.when(hit(r), r["family"]) for r in containers]) if containers else F.lit(None).cast("string")
    out = records.withColumn("family", family)
    fields = F.create_map().cast("map<string,string>")
    for r in sorted((r for r in rules if r["layer"] == "content"), key=lambda r: (r["priority"], r["id"])):
        gate = hit(r) if r["family"] is None else hit(r) & (F.col("family") == r["family"])
        got = F.create_map(*[x for i, n in enumerate(r["names"]) for x in (F.lit(n), F.regexp_extract(text, r["pattern"], i + 1))])
        older = F.map_filter(fields, _outside(r["names"]))
        fields = F.when(gate, F.map_concat(older, got)).otherwise(fields)
    return out.select(key, "family", fields.alias("fields"))
