"""Production parameters that queries and pipeline share."""

from __future__ import annotations

from ledgerbeam.llm.url_filter import Rule

# The rules that the URL filter is asked to apply.
URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
SURROGATE_KEY = "ledgerbeam"  # give a secret one in production
SHARDS = tuple(f"shard-{n:03d}" for n in range(128))


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file ``name`` is, on the driver as on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
