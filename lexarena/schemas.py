"""Declared schemas (DDL) of the engine's tables and inputs."""

from __future__ import annotations

DECISION = (
    "numero_processo string, tipo_decisao string, polo_ativo array<string>, polo_passivo array<string>, "
    "advogados_polo_ativo array<string>, advogados_polo_passivo array<string>, resultado string, data_decisao date, resumo string, tribunal string"
)
ENVELOPE = ("file_name_source string, extraction_timestamp string, chunks_processed int, total_decisions_found int, decisions string")
LISTING = ("year string, month string, day string, number string, url string, relativePath string, sufix string")
RATINGS = ("advogado_id string, mu double, sigma double, total_partidas int, created_at timestamp, updated_at timestamp")
MATCHES = (
    "id long, data_partida date, numero_processo string, equipe_a_ids array<string>, equipe_b_ids array<string>, "
    "ratings_equipe_a_antes map<string,struct<mu:double,sigma:double>>, ratings_equipe_b_antes map<string,struct<mu:double,sigma:double>>, "
    "ratings_equipe_a_depois map<string,struct<mu:double,sigma:double>>, ratings_equipe_b_depois map<string,struct<mu:double,sigma:double>>, "
    "resultado_partida string, decisao_id long, created_at timestamp"
)
JOB_QUEUE = (
    "url string, date date, tribunal string, filename string, metadata map<string,string>, status string, ia_identifier string, "
    "arquivo_path string, created_at timestamp, updated_at timestamp, error_message string, retry_count int"
)
PII_MAP = ("pii_uuid string, original_value string, value_for_uuid_ref string, pii_type string")
GAZETTE = ("tribunal string, data date, url string, filename string, hash string, pdf_path string, ia_identifier string, status string, metadata map<string,string>")
PAGE_ROWS = ("doc_id string, page int, text string")
