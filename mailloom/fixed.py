"""Fixed values that results depend on: taxonomy v1, prompt text, limits, verbs."""

from __future__ import annotations

# Taxonomy v1. Rule order is significant (the first match wins).
TAXONOMY_V1 = {
    "version": "v1",
    "tags": [
        {"name": "keep", "definition": "Correspondence, personal, work-relevant."},
        {
            "name": "receipt",
            "definition": "Purchase confirmations, invoices, bank/brokerage statements.",
            "subtags": ["receipt/bank", "receipt/purchase", "receipt/subscription"],
        },
        {
            "name": "notification",
            "definition": "Transactional/automated but non-financial (shipping, CI, calendar).",
        },
        {"name": "newsletter", "definition": "Subscribed periodic content."},
        {
            "name": "junk",
            "definition": "Marketing, cold outreach, expired promotions.",
            "subtags": ["junk/marketing"],
        },
        {
            "name": "unclassified",
            "definition": "Explicit residual bucket; must trend to zero by end of Pass 4.",
        },
    ],
    "keyword_rules": [
        {
            "tag": "junk",
            "fields": ["subject", "snippet"],
            "keywords": ["unsubscribe", "% off", "sale", "limited offer", "act now"],
        },
        {
            "tag": "receipt",
            "fields": ["subject"],
            "keywords": ["invoice", "receipt", "statement", "order confirmation", "payment"],
        },
        {
            "tag": "notification",
            "fields": ["subject"],
            "keywords": ["shipped", "delivered", "build passed", "build failed", "reminder"],
        },
        {
            "tag": "newsletter",
            "fields": ["subject", "snippet"],
            "keywords": ["newsletter", "digest", "weekly", "this week"],
        },
    ],
}

# Texts of a taxonomy in a prompt.
TAXONOMY_HEAD = "Taxonomy %s:"
TAG_LINE = "- %s: %s%s"
SUBTAGS_NOTE = " (subtags: %s)"

# Model prompt template of version classify_v1.
PROMPT_VERSION = "classify_v1"
PROMPT_CLASSIFY_V1 = """\
You are an email classifier. Assign exactly one tag from the taxonomy below to
the message. Prefer abstention: if unsure, use "unclassified" with low
confidence rather than guessing.

{taxonomy}

Respond with a JSON object only, matching:
{{"tag": "<one taxonomy tag>", "subtags": ["<optional subtag leaf>"],
  "confidence": <0.0-1.0>, "rationale": "<one sentence>"}}
"""

# Sampling sent with every model call.
SAMPLING = {"temperature": 0.0, "top_p": 1.0, "max_tokens": 200}

# Limits and defaults.
TAXONOMY_TOKEN_BUDGET = 1200
PAYLOAD_TOKEN_BUDGET = 300
PAYLOAD_CUT_STEP = 32
SNIPPET_LENGTH = 500
CHARS_PER_TOKEN = 4
CONFIDENCE_THRESHOLD = 0.7
COVERAGE_TARGET = 0.60
TOP_SENDERS = 100
TOP_SENDERS_PER_TAG = 10
LOWEST_CONFIDENCE = 15
UNCLASSIFIED = "unclassified"

# Mailbox commands that would change server state.
MUTATING_COMMANDS = [
    "STORE", "UID STORE", "EXPUNGE", "COPY", "UID COPY", "MOVE", "UID MOVE",
    "APPEND", "CREATE", "DELETE", "RENAME", "SETACL", "SUBSCRIBE",
]
