"""The corpus operators as queries over whole tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from tallyfold.llm import chat, langid, merkle, mixing, packing, pii, rules, secrets, simhash, spotsigs, tokens, trie, warc
from tallyfold.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The query's key, for synthetic tables only; real pseudonyms need a secret one.
TEST_KEY = "a key for test tables"

QUERIES = {
    "op1_packing": lambda spark, sf: packing.pack(table(spark, sf, "documents")),
    "op2_pii": lambda spark, sf: pii.pseudonymize(table(spark, sf, "documents"), TEST_KEY),
    "op3_quality_rules": lambda spark, sf: rules.quality(table(spark, sf, "documents")),
    "op4_spotsigs": lambda spark, sf: spotsigs.fingerprinted(table(spark, sf, "documents")),
    "op5_mixing": lambda spark, sf: mixing.mixture(table(spark, sf, "documents")),
    "op6_warc": lambda spark, sf: warc.archived(table(spark, sf, "pages")),
    "op7_token_counts": lambda spark, sf: tokens.token_counts(table(spark, sf, "documents"), vocabulary()),
    "op8_secrets": lambda spark, sf: secrets.scan(table(spark, sf, "documents")),
    "op9_simhash": lambda spark, sf: simhash.simhash_components(table(spark, sf, "documents")),
    "op10_language": lambda spark, sf: langid.identify(table(spark, sf, "documents")),
    "op11_chat": lambda spark, sf: chat.formatted(table(spark, sf, "conversations")),
    "op12_trie": lambda spark, sf: trie.conversation_tree(table(spark, sf, "conversations")),
    "op13_merkle": lambda spark, sf: merkle.manifest(table(spark, sf, "documents")),
}

ORACLES = {
    "op1_packing": packing.ORACLE,
    "op3_quality_rules": rules.ORACLE,
    "op5_mixing": mixing.oracle(),
    "op6_warc": warc.ORACLE,
    "op11_chat": chat.ORACLE,
    "op12_trie": trie.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
