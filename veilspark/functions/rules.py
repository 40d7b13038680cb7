"""Detector patterns and rule sets.

Rules are data: each rule set is an ordered list of ``(output name, pattern)``
pairs plus a guard and a mode. Spark evaluates them with ``rlike`` (Java regex)
prefixed by ``(?Ud)`` -- Unicode ``\\d \\s \\w \\b`` and ``.`` stopping only at
``\\n``, the closest Java gets to Python ``re`` on ``str`` -- and ``(?iUd)``
where the rule set ignores case. The DuckDB oracle uses the same pattern text
without the prefix (RE2 would read ``(?U)`` as "ungreedy").

Two patterns are re-expressed because RE2 (the oracle) cannot run the original
form; both keep the same language:
* the loose SSN area check is a look-ahead in the original; here it is an
  alternation over the first three digits;
* the compact IBAN tail ``(?:[A-Z0-9]?){0,16}`` is written ``[A-Z0-9]{0,16}``
  (same strings, no nested-quantifier backtracking).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# FIXED VALUES -- detector patterns. These must equal the reference's rules
# for right results; they are listed plainly, in the order the reference
# defines them (loose/v1 detectors, v0-only detectors, context detectors,
# strict/v2+ detectors, guards).
# ----------------------------------------------------------------------------
PATTERNS: dict[str, str] = {
    # structured PII, v0/v1 ("loose")
    "ssn_loose": r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d\d|6[0-57-9]\d|66[0-57-9])[-\s]?\d{2}[-\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_us_loose": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "phone_intl": r"\+\d{1,3}\s?\d{2,4}\s?\d{4,8}",
    "card_wide": r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "iban_compact": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
    "address_v1": r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s){1,3}(?:Street|St|Drive|Dr|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Terrace)\b",
    "dob_mmddyyyy": r"\b(?:0[1-9]|1[0-2])[/-]\d{2}[/-](?:19|20)\d{2}\b",
    "dl_number": r"\b(?:DL|D\.L\.)[-\s]?\w{2,4}[-\s]?\d{3,7}[-\s]?\d{2,7}\b",
    "routing_number": r"\b(?:routing|ABA)\s*(?:number|#|no\.?)?\s*\d{9}\b",
    "account_number": r"\b(?:account|acct)\s*(?:number|#|no\.?)?\s*\d{6,17}\b",
    # v0-only detectors
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "address_v0": r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s){1,3}(?:Street|St|Drive|Dr|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b",
    "salary_amount": r"(?:salary|income|make|earn|paid|wage|compensation).*?\$[\d,]+|\$[\d,]+.*?(?:salary|income|per year|annually|a year)",
    "first_person_noun": r"\b(?:my|I'm|I am|I was|I have|I got|I failed|I owe)\b.*(?:diagnosed|prescribed|therapist|doctor|medication|blood pressure|credit score|mortgage|arrested|divorced|custody|resign|salary|bank account|savings|debt|loan)",
    # personal context, v0 ("narrow")
    "possessive_health_narrow": r"\b(?:my|his|her|their)\s+(?:doctor|therapist|diagnosis|medication|condition|symptoms|blood pressure|prescription)",
    "possessive_financial_narrow": r"\b(?:my|his|her|their)\s+(?:salary|income|bank|mortgage|credit|debt|loan|savings|tax)",
    "possessive_legal_narrow": r"\b(?:my|his|her|their)\s+(?:lawyer|attorney|arrest|divorce|custody|hearing|case)",
    "named_relation_v0": r"\b(?:my\s+(?:boss|wife|husband|partner|friend|neighbor|son|daughter|mom|dad|mother|father|brother|sister|accountant|therapist|doctor))\s+[A-Z][a-z]+",
    # personal context, v1 ("wide")
    "possessive_health_wide": r"\b(?:my|his|her|their|I'm|I am)\b.*\b(?:doctor|therapist|diagnosis|diagnosed|medication|prescribed|blood pressure|prescription|surgery|checkup|exam|colonoscopy|tumor|miscarriage|psych ward|rehab|sober|relapsed|addicted|bulimia)",
    "possessive_financial_wide": r"\b(?:my|I|I'm|our|we)\b.*\b(?:salary|income|bank account|mortgage|credit score|credit card|401k|savings|debt|loan|owe|inheritance|earn|make \$|garnish)",
    "possessive_legal_wide": r"\b(?:my|I|I'm|I was|I've)\b.*\b(?:arrested|fired|resign|divorce|custody|sued|lawsuit|restraining order|probation|evict|whistleblow|court date|deport|asylum)",
    "named_relation_v1": r"\b(?:my\s+(?:boss|wife|husband|partner|friend|neighbor|son|daughter|mom|dad|mother|father|brother|sister|accountant|therapist|doctor|coworker|manager|supervisor|ex|ex-wife|ex-husband|ex-girlfriend|ex-boyfriend|spouse|landlord|teenager))\s+[A-Z][a-z]+",
    "confession": r"\b(?:I'm|I am|I was|I have|I've been|I feel|I think I'm|I cheated|I lied|I failed|I tested positive|I'm pregnant|I'm addicted|I'm undocumented|I'm afraid|I'm scared|I'm ashamed)",
    "first_person_dollar": r"\b(?:I|my|we|our)\b.*\$[\d,]+",
    # structured PII, v2+ ("strict")
    "ssn_strict": r"\b\d{3}[-]\d{2}[-]\d{4}\b",
    "card_narrow": r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "iban_spaced": r"\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{0,2}\b",
    "phone_de": r"\b0\d{3,4}\s?\d{6,8}\b",
    "phone_us_strict": r"\b\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    # corpus keyword filters (matched ignoring case)
    "kw_personal": r"\b(my doctor|my salary|I was diagnosed|my therapist|I earn|my debt|I was fired|my divorce|mein Arzt|mein Gehalt|meine Schulden|ich wurde|mein Anwalt|I owe|my credit|my boss)\b",
    "kw_topic": r"\b(explain|how does|what is|difference between|implement|algorithm|write a|code|function|erkläre|was ist|wie funktioniert|unterschied|programmier|tutorial|beispiel)\b",
    "kw_first_person": r"\b(my |I was |I have |I am |mein |ich bin |ich habe |ich wurde )",
    # code guards (always matched ignoring case)
    "guard_v1_authoring": r"(?:regex|pattern|match|validate|function|test|fixture|faker|mock|example|schema|CSV|columns|template|write a|design a|implement|build a|how do I|library|generate fake)",
    "guard_v1_syntax": r"(?:r'|r\"|`|\{.*:.*\}|def |class |import |from )",
    "guard_v1_question": r"(?:what (?:is|are) the|how (?:do|does|should)|explain|what happens|what are typical|what is the (?:average|median|process|statute))",
    "guard_broad": r"(?:regex|pattern|validate|test|fixture|faker|mock|example|schema|CSV|template|write a|implement|library|generate|function|def |class |import |r'|r\"|`|\{.*:.*\}|how do I (?:write|build|implement|create|design))",
    "guard_narrow": r"(?:regex|pattern|validate|test fixture|faker|mock|schema|CSV|write a|implement|library|generate|def |class |import |r'|r\")",
}

# Detector id (query key suffix) -> (pattern key, ignore case) as the reference
# applies it: v0/v1 detectors ignore case, v2+ detectors do not.
DETECTORS: dict[str, tuple[str, bool]] = {
    "ssn_loose": ("ssn_loose", True),
    "ssn_strict": ("ssn_strict", False),
    "email": ("email", False),
    "phone_us_loose": ("phone_us_loose", True),
    "phone_us_strict": ("phone_us_strict", False),
    "phone_intl": ("phone_intl", False),
    "phone_de": ("phone_de", False),
    "card_wide": ("card_wide", True),
    "card_narrow": ("card_narrow", False),
    "iban_compact": ("iban_compact", True),
    "iban_spaced": ("iban_spaced", False),
    "ip_address": ("ip_address", True),
    "passport": ("passport", True),
    "street_address": ("address_v1", True),
    "birth_date": ("dob_mmddyyyy", True),
    "driver_licence": ("dl_number", True),
    "routing_number": ("routing_number", True),
    "account_number": ("account_number", True),
    "salary_amount": ("salary_amount", True),
    "first_person_noun": ("first_person_noun", True),
    "possessive_health": ("possessive_health_wide", True),
    "possessive_financial": ("possessive_financial_wide", True),
    "possessive_legal": ("possessive_legal_wide", True),
    "named_relation": ("named_relation_v1", True),
    "confession": ("confession", True),
    "first_person_dollar": ("first_person_dollar", True),
    "address_v0": ("address_v0", True),
    "possessive_health_narrow": ("possessive_health_narrow", True),
    "possessive_financial_narrow": ("possessive_financial_narrow", True),
    "possessive_legal_narrow": ("possessive_legal_narrow", True),
    "named_relation_v0": ("named_relation_v0", True),
}


@dataclass(frozen=True)
class RuleSet:
    """An ordered rule set.

    mode:
      ``plain``   any hit -> SENSITIVE, no guard (v0);
      ``tiered``  tier 1 first, tier 2 only when tier 1 is empty; a guard hit
                  turns a hit into UNCERTAIN and appends ``code_context`` (v1);
      ``guard_first`` guard hit -> UNCERTAIN with no names, else any hit (v2+).
    """
    name: str
    mode: str
    tiers: tuple[tuple[tuple[str, str], ...], ...]
    ignore_case: bool
    guards: tuple[str, ...] = field(default_factory=tuple)


# ----------------------------------------------------------------------------
# FIXED VALUES -- rule sets: output names and order as in each reference run.
# ----------------------------------------------------------------------------
RULE_SETS: dict[str, RuleSet] = {
    "v0": RuleSet("v0", "plain", ((
        ("ssn", "ssn_loose"), ("email", "email"), ("phone_us", "phone_us_loose"),
        ("phone_intl", "phone_intl"), ("credit_card", "card_wide"), ("iban", "iban_compact"),
        ("ip_address", "ip_address"), ("passport", "passport"), ("address", "address_v0"),
        ("dob_mmddyyyy", "dob_mmddyyyy"), ("salary_amount", "salary_amount"),
        ("my_personal", "first_person_noun"),
        ("possessive_health", "possessive_health_narrow"),
        ("possessive_financial", "possessive_financial_narrow"),
        ("possessive_legal", "possessive_legal_narrow"),
        ("named_person_context", "named_relation_v0"),
    ),), ignore_case=True),
    "v1": RuleSet("v1", "tiered", ((
        ("ssn", "ssn_loose"), ("email", "email"), ("phone_us", "phone_us_loose"),
        ("phone_intl", "phone_intl"), ("credit_card", "card_wide"), ("iban", "iban_compact"),
        ("passport", "passport"), ("address_street", "address_v1"),
        ("dob_mmddyyyy", "dob_mmddyyyy"), ("dl_number", "dl_number"),
        ("routing_number", "routing_number"), ("account_number", "account_number"),
    ), (
        ("possessive_health", "possessive_health_wide"),
        ("possessive_financial", "possessive_financial_wide"),
        ("possessive_legal", "possessive_legal_wide"),
        ("named_person_context", "named_relation_v1"),
        ("personal_confession", "confession"),
        ("specific_dollar_personal", "first_person_dollar"),
    )), ignore_case=True,
        guards=("guard_v1_authoring", "guard_v1_syntax", "guard_v1_question")),
    "v2": RuleSet("v2", "guard_first", ((
        ("ssn", "ssn_strict"), ("email", "email"), ("credit_card", "card_narrow"),
        ("iban", "iban_spaced"), ("phone_intl", "phone_intl"),
    ),), ignore_case=False, guards=("guard_broad",)),
    "v3": RuleSet("v3", "guard_first", ((
        ("email", "email"), ("credit_card", "card_narrow"), ("iban", "iban_spaced"),
        ("ssn", "ssn_strict"),
    ),), ignore_case=False, guards=("guard_narrow",)),
    "v4": RuleSet("v4", "guard_first", ((
        ("email", "email"), ("credit_card", "card_narrow"), ("iban", "iban_spaced"),
        ("ssn", "ssn_strict"), ("phone_intl", "phone_intl"), ("phone_de", "phone_de"),
        ("phone_us", "phone_us_strict"),
    ),), ignore_case=False, guards=("guard_narrow",)),
}

GUARDS: dict[str, tuple[str, ...]] = {
    "v1": RULE_SETS["v1"].guards,
    "broad": ("guard_broad",),
    "narrow": ("guard_narrow",),
}


# What a text must hold for a pattern to match at all: a cheap test that spares
# most texts the search. Every pattern not listed here or in NEEDS needs none.
NEEDS_DIGIT = frozenset({
    "ssn_loose", "phone_us_loose", "phone_intl", "card_wide", "iban_compact", "passport", "address_v1",
    "dob_mmddyyyy", "dl_number", "routing_number", "account_number", "ip_address", "address_v0", "ssn_strict",
    "card_narrow", "iban_spaced", "phone_de", "phone_us_strict"})
NEEDS = {"email": "@", "salary_amount": "$", "first_person_dollar": "$"}


def java_pattern(key: str, ignore_case: bool) -> str:
    return ("(?iUd)" if ignore_case else "(?Ud)") + PATTERNS[key]


def has_digit(text: Column) -> Column:
    """A digit as ``(?U)\\d`` has it; null for a null text."""
    return text.rlike(r"(?U)\d")


def matches(text: Column, key: str, ignore_case: bool, digit: Column | None = None) -> Column:
    """Boolean detector column; null text -> false (never null). ``digit`` is
    ``has_digit(text)`` where the caller has projected it already."""
    hit = text.rlike(java_pattern(key, ignore_case))
    if key in NEEDS:
        hit = F.contains(text, F.lit(NEEDS[key])) & hit
    elif key in NEEDS_DIGIT:
        hit = (has_digit(text) if digit is None else digit) & hit
    return F.coalesce(hit, F.lit(False))


def any_match(text: Column, keys: tuple[str, ...] | list[str], ignore_case: bool = True,
              digit: Column | None = None) -> Column:
    """OR of detectors, written first-to-last so evaluation short-circuits."""
    out = None
    for k in keys:
        c = matches(text, k, ignore_case, digit)
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def hit_names(text: Column, rules: tuple[tuple[str, str], ...], ignore_case: bool,
              digit: Column | None = None) -> Column:
    """array<string> of the names of matching rules, in rule order."""
    return F.filter(
        F.array(*[F.when(matches(text, key, ignore_case, digit), F.lit(name)) for name, key in rules]),
        lambda x: x.isNotNull(),
    )
