"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpedfa, bytebpe, chat, decontam, langid, merkle, pii, quality, rules, simhash, tokenstore, warc, whitening
from .common import table


def op1_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    return chat.read_back(chat.format_chat(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_quality_rules(spark, sf_dir):
    return rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_decontamination(spark, sf_dir):
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_ids(spark, sf_dir):
    return tokenstore.write_and_read(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bytebpe.round_trip(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark, sf_dir):
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op11_bpe_automaton(spark, sf_dir):
    return bpedfa.round_trip(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.check_tampering(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_pii": op1_pii, "op2_chat_format": op2_chat_format, "op3_quality_rules": op3_quality_rules, "op4_decontamination": op4_decontamination, "op5_token_ids": op5_token_ids, "op6_language_id": op6_language_id, "op7_byte_bpe": op7_byte_bpe, "op8_simhash": op8_simhash, "op9_quality": op9_quality, "op10_warc": op10_warc, "op11_bpe_automaton": op11_bpe_automaton, "op12_merkle_manifest": op12_merkle_manifest, "op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.ORACLE_SQL, "op4_decontamination": decontam.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
