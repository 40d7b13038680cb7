"""Prompt configurations and prompt/request rendering.

A configuration is one (model, prompt) pair. Configs are a small parameter
table: they are expanded onto the case rows with ``explode`` of a literal
array (a Generate node, not a join), so the large side never shuffles for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ----------------------------------------------------------------------------
# FIXED VALUES -- prompt texts, example lists, models and endpoints as the
# reference's v4/v5 runs use them. Values must stay verbatim: the rendered
# prompt is the input a scorer sees.
# ----------------------------------------------------------------------------
SYSTEM_D = """You are a privacy classifier. Respond with SENSITIVE or PUBLIC only.

SENSITIVE: Contains or reveals personal/private information about a specific real person — health, financial, legal, relationships, confessions, contact info, ID numbers. Includes third-party messages that reference a named person's private data (bank notifications, medical records, HR emails). Any language.

PUBLIC: General knowledge, coding, education, or topics discussed without a specific person's private context. Generic business content without personal identifiers is PUBLIC. Code with fake/test data is PUBLIC."""

TEMPLATE_D = '''Examples:
Message: "My credit score dropped to 620 after missing mortgage payments" -> SENSITIVE
Message: "Customer Joe_Schuster53, we need to verify your IMEI for recent banking updates" -> SENSITIVE
Message: "Mein Gehalt beträgt 65.000 Euro im Jahr und ich möchte verhandeln" -> SENSITIVE
Message: "Erreichen Sie mich unter 0176 12345678 nach 17 Uhr" -> SENSITIVE
Message: "How do I implement a binary search tree in Python?" -> PUBLIC
Message: "Was sind die Symptome von Typ-2-Diabetes?" -> PUBLIC
Message: "What are the penalties for a first-time DUI offense?" -> PUBLIC
Message: "Write a tutorial on building a REST API with FastAPI" -> PUBLIC

Message: "{text}"
Classification:'''

SYSTEM_F = """You are a privacy classifier. Respond with SENSITIVE or PUBLIC only.

SENSITIVE: The message is about a SPECIFIC PERSON's private situation. It contains someone's personal data, health details, financial specifics, legal situation, relationship, or confession. Third-party messages referencing a named person's private data count. Any language.

PUBLIC: The message asks ABOUT A TOPIC in general — even sensitive topics like divorce, medical conditions, salaries, or legal issues. If no specific person's private information is revealed, it is PUBLIC. Code, tutorials, and educational content are PUBLIC. Generic questions using "I" without revealing private specifics are PUBLIC."""

TEMPLATE_F = '''Examples:
Message: "My credit score dropped to 580 after missing mortgage payments" -> SENSITIVE
Message: "Customer Joe_Schuster53, verify your account 48308813" -> SENSITIVE
Message: "Mein Arzt hat bei mir Diabetes diagnostiziert" -> SENSITIVE
Message: "I was arrested for DUI and need a lawyer" -> SENSITIVE
Message: "What are the penalties for a first-time DUI offense?" -> PUBLIC
Message: "What are the grounds for divorce in California?" -> PUBLIC
Message: "Was sind die Symptome von Typ-2-Diabetes?" -> PUBLIC
Message: "How much does a software engineer earn in NYC?" -> PUBLIC
Message: "Design a database schema for storing credit card info" -> PUBLIC
Message: "Was passiert bei einer Privatinsolvenz?" -> PUBLIC

Message: "{text}"
Classification:'''

SYSTEM_G = """You are a privacy classifier. Respond with SENSITIVE or PUBLIC only.

The key question: Does this message reveal a SPECIFIC PERSON's private information?

SENSITIVE: Yes — it contains someone's personal health details, financial data, legal situation, relationship issue, confession, contact info, or ID number. Messages from institutions about a named person's private data are also SENSITIVE.

PUBLIC: No — even if the TOPIC is sensitive (divorce, medical conditions, salaries, arrests, bankruptcy), if no specific person's private data is revealed, it is PUBLIC. General questions, coding, tutorials, legal/medical information requests, and discussions about topics in the abstract are all PUBLIC."""

TEMPLATE_G = '''Examples:
Message: "My credit score dropped to 580 after missing payments" -> SENSITIVE
Message: "Customer Joe_Schuster53, verify your account 48308813" -> SENSITIVE
Message: "Mein Gehalt beträgt 65.000 Euro im Jahr" -> SENSITIVE
Message: "I was diagnosed with diabetes last month" -> SENSITIVE
Message: "What are the penalties for a first-time DUI?" -> PUBLIC
Message: "What are the grounds for divorce in California?" -> PUBLIC
Message: "Wie funktioniert das Scheidungsrecht in Deutschland?" -> PUBLIC
Message: "What medications are commonly prescribed for ADHD?" -> PUBLIC
Message: "How much does a software engineer earn in Munich?" -> PUBLIC
Message: "Design a database schema for encrypted credit card data" -> PUBLIC

Message: "{text}"
Classification:'''

TEMPLATE_G_STRIPPED = '''Examples:
Message: "My credit score dropped to 580 after missing payments" -> SENSITIVE
Message: "I was diagnosed with diabetes last month" -> SENSITIVE
Message: "How do I implement a binary search tree in Python?" -> PUBLIC
Message: "What are the symptoms of type 2 diabetes?" -> PUBLIC

Message: "{text}"
Classification:'''

# Seed example list of the few-shot search (prompt G's examples as pairs).
SEED_EXAMPLES: list[tuple[str, str]] = [
    ("My credit score dropped to 580 after missing payments", "SENSITIVE"),
    ("Customer Joe_Schuster53, verify your account 48308813", "SENSITIVE"),
    ("Mein Gehalt beträgt 65.000 Euro im Jahr", "SENSITIVE"),
    ("I was diagnosed with diabetes last month", "SENSITIVE"),
    ("What are the penalties for a first-time DUI?", "PUBLIC"),
    ("What are the grounds for divorce in California?", "PUBLIC"),
    ("Wie funktioniert das Scheidungsrecht in Deutschland?", "PUBLIC"),
    ("What medications are commonly prescribed for ADHD?", "PUBLIC"),
    ("How much does a software engineer earn in Munich?", "PUBLIC"),
    ("Design a database schema for encrypted credit card data", "PUBLIC"),
]

# Seeded starting demos of the optimizer variant: balanced 5 SENSITIVE + 5 PUBLIC.
SEED_DEMOS_BALANCED: list[tuple[str, str]] = [
    ("My credit score dropped to 580 after missing payments", "SENSITIVE"),
    ("Customer Joe_Schuster53, verify your account 48308813", "SENSITIVE"),
    ("Mein Gehalt beträgt 65.000 Euro im Jahr", "SENSITIVE"),
    ("I was diagnosed with diabetes last month", "SENSITIVE"),
    ("I was arrested for DUI and need a lawyer", "SENSITIVE"),
    ("What are the penalties for a first-time DUI?", "PUBLIC"),
    ("What are the grounds for divorce in California?", "PUBLIC"),
    ("Wie funktioniert das Scheidungsrecht in Deutschland?", "PUBLIC"),
    ("What medications are commonly prescribed for ADHD?", "PUBLIC"),
    ("Design a database schema for encrypted credit card data", "PUBLIC"),
]

PROMPTS: list[dict] = [
    {"prompt_name": "D: v3 baseline", "system": SYSTEM_D, "template": TEMPLATE_D},
    {"prompt_name": "F: topic-vs-person distinction", "system": SYSTEM_F, "template": TEMPLATE_F},
    {"prompt_name": "G: topic-vs-person + hard PUBLIC examples", "system": SYSTEM_G, "template": TEMPLATE_G},
    {"prompt_name": "G-stripped: reframe only", "system": SYSTEM_G, "template": TEMPLATE_G_STRIPPED},
]

MODELS: list[str] = ["gemma3:1b", "llama3.2:3b", "qwen3:1.7b", "qwen3:4b"]
# Models served through the chat endpoint (thinking models); the rest use generate.
CHAT_MODELS: frozenset[str] = frozenset({"qwen3:1.7b", "qwen3:4b"})
# Decode limits: 10 new tokens, 1000 for thinking models on the chat endpoint.
MAX_TOKENS_DEFAULT = 10
MAX_TOKENS_THINKING = 1000
MODEL_FAMILY_SEPARATOR = " | "


def endpoint_for(model: str) -> str:
    return "chat" if model in CHAT_MODELS else "generate"


def default_configs(models: list[str] | None = None, prompt_names: list[str] | None = None) -> list[dict]:
    """models x prompts, numbered in loop order (model outer, prompt inner) as
    the reference's nested loops enumerate them. Default: the v4 grid."""
    models = models or ["gemma3:1b", "llama3.2:3b"]
    prompt_names = prompt_names or [p["prompt_name"] for p in PROMPTS[:3]]
    by_name = {p["prompt_name"]: p for p in PROMPTS}
    out = []
    for m in models:
        for pn in prompt_names:
            p = by_name[pn]
            out.append({
                "config_id": len(out) + 1, "model": m, "endpoint": endpoint_for(m),
                "prompt_name": pn, "system": p["system"], "template": p["template"],
                "max_tokens": MAX_TOKENS_THINKING if m in CHAT_MODELS else MAX_TOKENS_DEFAULT,
                "name": f"{m}{MODEL_FAMILY_SEPARATOR}{pn}",
            })
    return out


CONFIG_SCHEMA = T.StructType([
    T.StructField("config_id", T.IntegerType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("prompt_name", T.StringType(), False),
    T.StructField("system", T.StringType(), False),
    T.StructField("template", T.StringType(), False),
    T.StructField("max_tokens", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])


def config_array(configs: list[dict], fields: tuple[str, ...] = ("config_id", "model", "endpoint", "prompt_name")) -> Column:
    """Literal array<struct> of the (bounded) parameter table."""
    return F.array(*[F.struct(*[F.lit(c[f]).alias(f) for f in fields]) for c in configs])


def with_configs(df: DataFrame, configs: list[dict],
                 fields: tuple[str, ...] = ("config_id", "model", "endpoint", "prompt_name")) -> DataFrame:
    """Expand every row once per config (E3) via explode of a literal array:
    a narrow Generate, no join, no shuffle; only the fields asked for travel."""
    return (df.withColumn("_cfg", F.explode(config_array(configs, fields)))
              .select(*[c for c in df.columns], *[F.col(f"_cfg.{f}").alias(f) for f in fields]))


def configs_frame(spark, configs: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(c[f.name] for f in CONFIG_SCHEMA.fields) for c in configs], CONFIG_SCHEMA)


MOST_CONFIGS = 1000


def configs_of(table: DataFrame) -> list[dict]:
    """Configurations read from a table (E3): ``config_id, model, prompt_name,
    system, template`` and optionally ``max_tokens``; endpoint, limit and name
    follow from them. A grid is a parameter table: more than ``MOST_CONFIGS``
    rows are refused, none is left out."""
    rows = table.limit(MOST_CONFIGS + 1).collect()
    if len(rows) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    out = []
    for r in sorted((r.asDict() for r in rows), key=lambda r: r["config_id"]):
        default = MAX_TOKENS_THINKING if r["model"] in CHAT_MODELS else MAX_TOKENS_DEFAULT
        out.append({"config_id": r["config_id"], "model": r["model"], "endpoint": endpoint_for(r["model"]),
                    "prompt_name": r["prompt_name"], "system": r["system"], "template": r["template"],
                    "max_tokens": r.get("max_tokens") or default,
                    "name": f"{r['model']}{MODEL_FAMILY_SEPARATOR}{r['prompt_name']}"})
    return out


def model_family(name: Column) -> Column:
    """Model part of a legacy run name "model | prompt" (B12)."""
    return F.split_part(name, F.lit(MODEL_FAMILY_SEPARATOR), F.lit(1))


def endpoint_column(model: Column) -> Column:
    """Endpoint by model-family membership."""
    return F.when(model.isin(*sorted(CHAT_MODELS)), F.lit("chat")).otherwise(F.lit("generate"))


def render_prompt(template: Column, text: Column) -> Column:
    """Literal substitution of the ``{text}`` hole (braces, ``$`` and
    backslashes in the message pass untouched)."""
    return F.replace(template, F.lit("{text}"), text)


def render_fewshot_prompt(examples: Column, text: Column, cut: int = 150) -> Column:
    """B6: "Examples:" line, one line per example (text cut to ``cut`` chars),
    then a blank line, the message and "Classification:"."""
    ex_lines = F.transform(examples, lambda e: F.concat(
        F.lit('Message: "'), F.substring(e["text"], 1, cut), F.lit('" -> '), e["label"]))
    tail = F.concat(F.lit('\nMessage: "'), text, F.lit('"\nClassification:'))
    return F.array_join(F.concat(F.array(F.lit("Examples:")), ex_lines, F.array(tail)), "\n")


def examples_literal(examples: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(l).alias("label")) for t, l in examples])


def build_request(model: Column, system: Column, user: Column, max_tokens: Column) -> Column:
    """Chat request body for a batch scorer, as JSON text."""
    return F.to_json(F.struct(
        model.alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
        F.lit(False).alias("stream"),
        F.struct(F.lit(0).alias("temperature"), max_tokens.alias("num_predict")).alias("options"),
    ))
