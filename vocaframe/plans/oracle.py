"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views.
Stand-in inputs are derived by the same formulas as ``standins``; the
operators themselves are restated independently (plain windows instead of
blocked windows, a cross join for the one-row target, list lambdas).
"""

from __future__ import annotations

from .. import constants as K
from . import sqlgen as G
from . import standins as S

M = K.SPEECH_START_MARKER

UTT_N = "((event_id * 37) % 41)"
UTT_CODES = f"list_transform(range({UTT_N}), lambda i: ((event_id * 7919 + i * 104729) % 65536)::INTEGER)"
GEN_IDS = (
    "list_concat(list_transform(range(event_id % 4), lambda j: (128000 + j)::BIGINT), "
    f"list_transform(range({UTT_N}), lambda i: (CASE WHEN (event_id + i) % 97 = 0 THEN 128261 "
    "WHEN (event_id + i) % 13 = 0 THEN 193800 + i % 3 WHEN (event_id + i) % 29 = 0 THEN 128263 "
    "ELSE (event_id * 7919 + i * 104729) % 65536 + 128264 END)::BIGINT))"
)
SENT_CODES = (
    "CASE WHEN role = 'system' THEN NULL ELSE list_transform(range(CASE WHEN turn % 4 = 3 THEN 0 "
    "ELSE (conv_id + turn * 5) % 30 END), lambda i: ((conv_id * 31 + turn * 7 + i + 1) % 65536)::INTEGER) END"
)
REF_AUDIO = (
    "CASE WHEN conv_id % 3 = 0 THEN NULL ELSE "
    "list_transform(range(8), lambda i: ((conv_id * 13 + i) % 65536)::INTEGER) END"
)
BRACKET_STRIP = "trim(trim(s, '['), ']')"
EXTRACT = r"regexp_extract_all({s}, '<\|s_(\d+)\|>', 1)"

UTT = f"utt AS (SELECT event_id AS utt_id, user_id AS speaker, event_type, {UTT_CODES} AS codes FROM events)"
SENT = f"sent AS (SELECT conv_id, turn, role, text, {SENT_CODES} AS codes FROM conversations)"
TEXTS = (f"t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM "
         f"{G.values(S.TEXT_EDGE_ROWS, 'doc_id, text')})")
LINES = (f"lines AS (SELECT doc_id AS line_key, {S.MANIFEST_LINE} AS line FROM documents UNION ALL "
         f"SELECT line_key, line FROM {G.values(S.MANIFEST_EDGE_LINES, 'line_key, line')})")
PARSED = (
    f"sp AS (SELECT line_key, string_split({G.py_strip('line')}, ':') AS parts FROM lines), "
    "fl AS (SELECT line_key, parts[1] AS fid, parts[2] AS txt FROM sp), "
    f"parsed AS (SELECT line_key, {G.py_strip('fid')} AS file_id, {G.py_strip('txt')} AS text "
    "FROM fl WHERE fid <> '' AND txt <> '')"
)
DEDUP = ("dedup AS (SELECT file_id, arg_max(text, line_key) AS text, min(line_key) AS first_key, "
         "count(*) AS n_lines FROM parsed GROUP BY file_id)")
PREFIX = S.AUDIO_DIR + "/"
CORPUS = (
    "inv AS (SELECT DISTINCT " + S.INVENTORY_PATH + " AS path, d.n_chars AS n_chars "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
    f"ids AS (SELECT substring(path, {len(PREFIX) + 1}, length(path) - {len(PREFIX) + 4}) AS file_id, n_chars "
    f"FROM inv WHERE starts_with(path, {G.q(PREFIX)}) AND ends_with(path, '.wav')), "
    "codes AS (SELECT file_id, list_transform(range(n_chars % 23), "
    "lambda i: ((n_chars * 7 + i * 31) % 65536)::INTEGER) AS code FROM ids), "
    "built AS (SELECT d.file_id, d.text, c.code FROM dedup d JOIN codes c ON d.file_id = c.file_id "
    "WHERE c.code IS NOT NULL)"
)
SCORED = (
    "r AS (SELECT vec_id, '/refs/' || CAST(label AS VARCHAR) || '/v' || CAST(vec_id // 2 AS VARCHAR) || '.wav' "
    "AS path, embedding FROM embeddings), "
    f"tg AS (SELECT embedding AS tv FROM r WHERE vec_id = {S.TARGET_VEC_ID}), "
    f"scored AS (SELECT vec_id, path, {G.cosine('embedding', 'tv')} AS similarity FROM r, tg "
    f"WHERE vec_id <> {S.TARGET_VEC_ID})"
)
TRIMMED = "list_slice(codes, 1, greatest(len(codes) - 16, 0))"
STITCH = (
    f"m AS (SELECT conv_id, turn, codes, {TRIMMED} AS trimmed, "
    "max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM sent), "
    "k AS (SELECT conv_id, turn, turn = last_turn AS is_last, "
    "CASE WHEN turn = last_turn THEN codes ELSE trimmed END AS kept, coalesce(len(trimmed), 0) AS tlen FROM m), "
    "o AS (SELECT *, coalesce(sum(tlen) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_seq FROM k)"
)
REQ = (
    f"req AS (SELECT conv_id, turn, text AS input, {G.q(K.DEFAULT_MODEL_ID)} AS model, 'alloy' AS voice, "
    f"coalesce({S.REQ_FORMAT}, 'mp3') AS response_format, coalesce({S.REQ_SPEED}, 1.0) AS speed, "
    f"coalesce({S.REQ_TEMPERATURE}, 0.7) AS temperature, coalesce({S.REQ_TOP_P}, 0.9) AS top_p, "
    f"coalesce({S.REQ_REPEAT_PENALTY}, 1.1) AS repeat_penalty, coalesce({S.REQ_MAX_TOKENS}, 300) AS max_tokens "
    "FROM conversations), "
    f"vn AS (SELECT *, {G.normalize('input')} AS input_norm FROM req), "
    "vv AS (SELECT *, list_filter(["
    "CASE WHEN input IS NULL THEN 'input' END, "
    "CASE WHEN response_format NOT IN ('mp3', 'opus', 'aac', 'flac', 'wav', 'pcm') THEN 'response_format' END, "
    "CASE WHEN NOT (speed BETWEEN 0.25 AND 4.0) THEN 'speed' END, "
    "CASE WHEN NOT (temperature BETWEEN 0.0 AND 2.0) THEN 'temperature' END, "
    "CASE WHEN NOT (top_p BETWEEN 0.0 AND 1.0) THEN 'top_p' END, "
    "CASE WHEN NOT (repeat_penalty BETWEEN 0.0 AND 2.0) THEN 'repeat_penalty' END, "
    "CASE WHEN NOT (max_tokens BETWEEN 1 AND 2048) THEN 'max_tokens' END, "
    "CASE WHEN coalesce(length(input_norm), 0) = 0 THEN 'empty_after_normalization' END"
    "], lambda x: x IS NOT NULL) AS viol FROM vn)"
)
WAVE_N = "(1 + event_id % 50)"
WAVE_MONO = (f"list_transform(range({WAVE_N}), lambda j: (((((event_id * 31 + j * 17) % 2001 - 1000)::FLOAT / 32768) "
             "+ (((event_id * 17 + j * 31) % 4001 - 2000)::FLOAT / 32768)) / 2)::FLOAT)")
WAVE_RATE = S.WAVE_RATE
WAVE_CHANNELS = S.WAVE_CHANNELS
WAVE_BITS = S.WAVE_BITS.replace(" DIV ", " // ")


def _sum(expr: str) -> str:
    return f"list_reduce({expr}, lambda a, b: a + b, 0.0::DOUBLE)"


ORACLE_SQL: dict[str, str] = {
    "normalize_text": (
        f"WITH {TEXTS} SELECT doc_id, {G.normalize('text')} AS norm_text, "
        f"{G.normalize('text', 2)} AS norm_text_2 FROM t"
    ),
    "normalize_text_kana": (
        f"WITH {TEXTS}, h AS (SELECT doc_id, translate(text, {G.q(S.KANA_LETTERS[0])}, {G.q(S.KANA_LETTERS[1])}) AS text FROM t) "
        f"SELECT doc_id, {G.normalize_kana('text')} AS norm_text FROM h"
    ),
    "text_preview": (
        f"WITH {TEXTS}, tn AS (SELECT doc_id, text, {G.normalize('text')} AS n FROM t) "
        f"SELECT doc_id, {G.preview('text')} AS preview, {G.preview('n')} AS norm_preview FROM tn"
    ),
    "speech_token_render": (
        f"WITH {UTT} SELECT utt_id, {G.speech_tokens('codes')} AS tokens, len(codes)::BIGINT AS n_codes FROM utt"
    ),
    "speech_id_extract": (
        f"WITH {UTT}, x AS (SELECT utt_id, codes, list_transform("
        + EXTRACT.format(s="'x' || " + G.speech_tokens("codes") + " || '<|s_|>' || event_type")
        + ", lambda s: s::BIGINT) AS ids FROM utt) "
        f"SELECT utt_id, {G.code_list('ids')} AS ids, len(ids)::BIGINT AS n_ids, "
        "(ids = codes::BIGINT[]) AS roundtrip_ok FROM x"
    ),
    "generated_id_decode": (
        f"WITH g AS (SELECT event_id AS utt_id, (event_id % 4)::INTEGER AS prompt_len, {GEN_IDS} AS ids FROM events), "
        "s AS (SELECT utt_id, prompt_len, list_slice(ids, prompt_len + 1, len(ids)) AS gen FROM g), "
        "p AS (SELECT utt_id, prompt_len, gen, coalesce(list_position(gen, 128261), 0) AS e FROM s), "
        "d AS (SELECT utt_id, prompt_len, list_transform(list_filter("
        "CASE WHEN e = 0 THEN gen ELSE list_slice(gen, 1, e - 1) END, lambda x: x >= 128264 AND x < 193800), "
        "lambda x: x - 128264) AS codes FROM p) "
        f"SELECT utt_id, prompt_len, {G.code_list('codes')} AS codes, len(codes)::BIGINT AS n_codes FROM d"
    ),
    "code_list_roundtrip": (
        f"WITH {UTT}, a AS (SELECT utt_id, codes, {G.code_list('codes')} AS code_list FROM utt), "
        "b AS (SELECT utt_id, codes, code_list, list_transform(string_split(code_list, ','), "
        f"lambda s: TRY_CAST({G.py_strip(BRACKET_STRIP)} AS INTEGER)) "
        "AS items FROM a), "
        "c AS (SELECT utt_id, codes, code_list, CASE WHEN list_contains(list_transform(items, lambda x: x IS NULL), "
        "true) THEN NULL ELSE items END AS parsed FROM b) "
        "SELECT utt_id, code_list, parsed IS NOT NULL AS parse_ok, coalesce(parsed = codes, false) AS roundtrip_ok "
        "FROM c"
    ),
    "training_prompt": f"WITH {SENT} SELECT conv_id, turn, {G.prompt('text', 'codes')} AS prompt FROM sent",
    "inference_prompt": (
        f"WITH {SENT} SELECT conv_id, turn, {G.prompt('text', None, end=False)} AS prompt FROM sent"
    ),
    "reference_prompt": (
        f"WITH {SENT}, f AS (SELECT conv_id, text AS ref_text, codes AS ref_codes, {REF_AUDIO} AS ref_audio_codes "
        "FROM sent WHERE turn = 0), "
        "j AS (SELECT s.conv_id, s.turn, CASE WHEN length(f.ref_text) > 0 THEN coalesce(f.ref_text, '') || s.text "
        "ELSE s.text END AS full_text, CASE WHEN len(f.ref_codes) > 0 THEN f.ref_codes ELSE f.ref_audio_codes END "
        "AS ref FROM sent s JOIN f ON s.conv_id = f.conv_id WHERE s.turn > 0) "
        f"SELECT conv_id, turn, {G.prompt('full_text', 'ref', end=False)} AS prompt FROM j"
    ),
    "completion_split": (
        f"WITH {SENT}, tp AS (SELECT conv_id, turn, {G.prompt('text', 'codes')} AS prompt FROM sent) "
        f"SELECT conv_id, turn, split_part(prompt, {G.q(M)}, 1) || {G.q(M)} AS prompt_text, "
        f"split_part(prompt, {G.q(M)}, 2) AS completion FROM tp"
    ),
    "training_shuffle": f"WITH {SENT} SELECT conv_id, turn, {G.prompt('text', 'codes')} AS prompt FROM sent",
    "manifest_parse": f"WITH {LINES}, {PARSED} SELECT line_key, file_id, text FROM parsed",
    "manifest_last_wins": f"WITH {LINES}, {PARSED}, {DEDUP} SELECT file_id, text, first_key, n_lines FROM dedup",
    "corpus_build": (
        f"WITH {LINES}, {PARSED}, {DEDUP}, {CORPUS} SELECT file_id, text, {G.code_list('code')} AS code_list, "
        "len(code)::BIGINT AS n_codes FROM built"
    ),
    "corpus_bucketed": f"WITH {LINES}, {PARSED}, {DEDUP}, {CORPUS} SELECT file_id, text, {G.code_list('code')} AS code_list FROM built",
    "corpus_report": (
        f"WITH {LINES}, {PARSED}, {DEDUP}, {CORPUS} "
        "SELECT 'lines' AS metric, count(*) AS value FROM lines "
        "UNION ALL SELECT 'valid_lines', count(*) FROM parsed "
        "UNION ALL SELECT 'texts', count(*) FROM dedup "
        "UNION ALL SELECT 'texts_without_audio', count(*) FROM dedup x "
        "WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.file_id = x.file_id) "
        "UNION ALL SELECT 'samples', count(*) FROM built"
    ),
    "corpus_roundtrip": (
        f"WITH {LINES}, {PARSED}, {DEDUP}, {CORPUS} SELECT text, {G.code_list('code')} AS code_list, "
        "len(code)::BIGINT AS n_codes FROM built"
    ),
    "segment_split": (
        f"WITH l AS (SELECT doc_id, {G.non_blank_lines('text')} AS lines FROM documents) "
        "SELECT doc_id, unnest(range(len(lines)))::BIGINT AS pos, unnest(lines) AS line FROM l"
    ),
    "segment_context": (
        f"WITH {SENT}, rf AS (SELECT conv_id, NULL::VARCHAR AS ref_text, {REF_AUDIO} AS ref_codes "
        "FROM conversations WHERE turn = 0), "
        f"lg AS (SELECT conv_id, turn, text, lag(text) OVER w AS prev_text, lag({TRIMMED}) OVER w AS prev_trimmed "
        "FROM sent WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
        "cx AS (SELECT lg.conv_id, lg.turn, lg.text, CASE WHEN lg.turn = 0 THEN rf.ref_text ELSE lg.prev_text END "
        "AS ctx_text, CASE WHEN lg.turn = 0 THEN rf.ref_codes ELSE lg.prev_trimmed END AS ctx_codes "
        "FROM lg LEFT JOIN rf ON lg.conv_id = rf.conv_id), "
        "ft AS (SELECT conv_id, turn, CASE WHEN length(ctx_text) > 0 THEN coalesce(ctx_text, '') || text "
        "ELSE text END AS full_text, ctx_codes FROM cx) "
        f"SELECT conv_id, turn, {G.prompt('full_text', 'ctx_codes', end=False)} AS prompt FROM ft"
    ),
    "segment_stitch": (
        f"WITH {SENT}, {STITCH} SELECT conv_id, turn, is_last, coalesce(len(kept), 0)::BIGINT AS n_kept, "
        "start_seq, CASE WHEN is_last THEN (start_seq + coalesce(len(kept), 0))::BIGINT END AS total, "
        "CASE WHEN is_last THEN start_seq + coalesce(len(kept), 0) > 0 END AS decodable, "
        f"{G.code_list('kept')} AS kept FROM o"
    ),
    "segment_stream": (
        f"WITH {SENT}, {STITCH} SELECT conv_id, (start_seq + unnest(range(len(kept))))::BIGINT AS seq, "
        "unnest(kept) AS code FROM o WHERE len(kept) > 0"
    ),
    "similarity_all": f"WITH {SCORED} SELECT vec_id, path, round(similarity, 6) AS similarity FROM scored",
    "similarity_top10": (
        f"WITH {SCORED}, rk AS (SELECT row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank, vec_id, "
        "similarity FROM scored) SELECT rank, vec_id, round(similarity, 6) AS similarity FROM rk WHERE rank <= 10"
    ),
    "similarity_csv": (
        f"WITH {SCORED}, nm AS (SELECT regexp_extract(path, '([^/]*)/*$', 1) AS name, vec_id, similarity "
        "FROM scored), g AS (SELECT name, min(vec_id) AS first_pos, arg_max(similarity, vec_id) AS sim "
        "FROM nm GROUP BY name) "
        "SELECT name, first_pos, round(sim, 6) AS similarity, printf('%s,%.4f', name, sim) AS line FROM g"
    ),
    "request_validate": (
        f"WITH {REQ} SELECT conv_id, turn, model, voice, response_format, speed, temperature, top_p, "
        "repeat_penalty, max_tokens, array_to_string(viol, ',') AS violations, len(viol) = 0 AS is_valid FROM vv"
    ),
    "request_payload": (
        f"WITH {REQ} SELECT conv_id, turn, {G.prompt('input_norm', None, bos=False, end=False)} AS prompt, "
        f"0.7::DOUBLE AS temperature, 0.9::DOUBLE AS top_p, {K.HTTP_ROUTE_MAX_TOKENS}::INTEGER AS max_tokens, "
        f"0::INTEGER AS min_tokens, 1.1::DOUBLE AS repetition_penalty, 1.1::DOUBLE AS repeat_penalty, "
        f"{K.SPEECH_END_ID}::BIGINT AS stop_id, false AS stream FROM vv WHERE len(viol) = 0"
    ),
    "response_parse": (
        f"WITH {UTT}, rs AS (SELECT utt_id, {S.RESP_STATUS.replace('event_id', 'utt_id')} AS status, "
        f"CASE WHEN len(codes) = 0 THEN '' ELSE event_type || {G.speech_tokens('codes')} || ' <|s_|>' END AS text "
        "FROM utt), "
        "er AS (SELECT utt_id, status, text, CASE WHEN status <> 200 THEN 'api_error' "
        "WHEN coalesce(length(text), 0) = 0 THEN 'empty_response' END AS error FROM rs), "
        "ex AS (SELECT utt_id, status, error, CASE WHEN error IS NULL THEN list_transform("
        + EXTRACT.format(s="text") + ", lambda s: s::BIGINT) END AS ids FROM er) "
        f"SELECT utt_id, status, error, {G.code_list('ids')} AS ids, len(ids)::BIGINT AS n_ids FROM ex"
    ),
    "token_metrics": (
        f"WITH {UTT}, n AS (SELECT speaker, len(codes)::BIGINT AS n FROM utt), "
        "a AS (SELECT speaker, count(*) AS n_utts, sum(n)::BIGINT AS total_tokens, max(n)::BIGINT AS max_tokens, "
        f"sum(n * {K.CODEC_FRAME_SAMPLES})::BIGINT AS total_samples, "
        "sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS n_empty FROM n GROUP BY speaker) "
        f"SELECT speaker, n_utts, total_tokens, max_tokens, total_samples, n_empty, "
        f"round(total_samples::DOUBLE / {float(K.SAMPLE_RATE)}, 6) AS total_seconds, "
        f"round(CASE WHEN total_samples = 0 THEN NULL ELSE total_tokens::DOUBLE / "
        f"(total_samples::DOUBLE / {float(K.SAMPLE_RATE)}) END, 6) AS tokens_per_second FROM a"
    ),
    "audio_preprocess": (
        f"WITH w AS (SELECT event_id AS utt_id, {WAVE_MONO} AS mono FROM events) "
        "SELECT utt_id, 16000 AS sample_rate, len(mono)::BIGINT AS n_samples, "
        f"round({_sum('list_transform(mono, lambda x: x::DOUBLE)')}, 9) AS sum_samples, "
        "list_min(mono)::DOUBLE AS min_sample, list_max(mono)::DOUBLE AS max_sample FROM w"
    ),
    "audio_resample": (
        f"SELECT event_id AS utt_id, ((400 * 16000 + rate - 1) // rate)::BIGINT AS n_samples, true AS level_kept "
        f"FROM (SELECT event_id, {S.LEVEL_RATE} AS rate FROM events)"
    ),
    "manifest_file": f"WITH {LINES}, {PARSED}, {DEDUP} SELECT file_id, text, n_lines FROM dedup",
    "training_table": f"WITH {SENT} SELECT {G.prompt('text', 'codes')} AS text FROM sent",
    "training_order": (
        "WITH k AS (SELECT conv_id, turn, md5('42|' || conv_id || '|' || turn) AS h FROM conversations) "
        "SELECT conv_id, turn, row_number() OVER (ORDER BY h, conv_id, turn) - 1 AS place FROM k"
    ),
    "training_shards": (
        f"WITH {SENT}, c AS (SELECT {G.prompt('text', 'codes')} AS text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS number, "
        "count(*) OVER () AS n FROM sent), "
        "o AS (SELECT text, (n + 6) // 7 AS size, row_number() OVER (ORDER BY md5('42|' || number), number) - 1 AS place FROM c) "
        "SELECT place // size AS shard, place % size AS place, text FROM o"
    ),
    "manifest_line_number": f"WITH {LINES} SELECT row_number() OVER (ORDER BY line_key) - 1 AS line_number, line FROM lines",
    "similarity_top10_per_target": (
        "WITH s AS (SELECT t.vec_id AS target, r.vec_id, "
        f"round({G.cosine('r.embedding', 't.embedding')}, 9) AS similarity FROM embeddings t JOIN embeddings r ON r.vec_id <> t.vec_id "
        "WHERE t.vec_id % 20 = 0), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, vec_id) AS rank FROM s) "
        "SELECT target, rank, vec_id, round(similarity, 6) AS similarity FROM k WHERE rank <= 10"
    ),
    "similarity_file": (
        f"WITH {SCORED}, nm AS (SELECT regexp_extract(path, '([^/]*)/*$', 1) AS name, vec_id, similarity "
        "FROM scored) SELECT printf('%s,%.4f', name, arg_max(similarity, vec_id)) AS line FROM nm GROUP BY name"
    ),
    "audio_resample_blocks": (
        "SELECT event_id AS utt_id, 4::BIGINT AS n_blocks, n AS total, n AS n_samples, n AS n_whole, n AS n_equal "
        f"FROM (SELECT event_id, ((400 * 16000 + rate - 1) // rate)::BIGINT AS n FROM (SELECT event_id, {S.LEVEL_RATE} AS rate FROM events))"
    ),
    "audio_frames": (
        f"WITH w AS (SELECT 's' || s_suppkey % 5 || '/_' || s_suppkey || '.x' AS file_id, {WAVE_MONO.replace('event_id', 's_suppkey')} AS mono "
        "FROM supplier WHERE s_suppkey % 3 <> 0) "
        "SELECT file_id, ((len(mono) + 15) // 16)::BIGINT AS n_blocks, len(mono)::BIGINT AS n_frames, 2::INTEGER AS n_channels, len(mono)::BIGINT AS n_samples, "
        f"round({_sum('list_transform(mono, lambda x: x::DOUBLE)')}, 9) AS sum_samples FROM w"
    ),
    "audio_files": (
        f"WITH w AS (SELECT s_suppkey, s_suppkey % 3 <> 0 AS has_audio, {WAVE_MONO.replace('event_id', 's_suppkey')} AS mono FROM supplier) "
        "SELECT s_suppkey, has_audio, CASE WHEN has_audio THEN len(mono) END::BIGINT AS n_frames, "
        "CASE WHEN has_audio THEN 2 END::INTEGER AS n_channels, CASE WHEN has_audio THEN len(mono) END::BIGINT AS n_samples, "
        f"CASE WHEN has_audio THEN round({_sum('list_transform(mono, lambda x: x::DOUBLE)')}, 9) END AS sum_samples FROM w"
    ),
    "corpus_files": (
        "SELECT 'v2 ' || s_name AS text, '[' || s_suppkey || ', 5]' AS code_list FROM supplier "
        "WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 NOT IN (0, 1)"
    ),
    "corpus_lint": (
        f"WITH h AS (SELECT event_id AS utt_id, ({WAVE_RATE})::INTEGER AS sample_rate, "
        f"({WAVE_CHANNELS})::INTEGER AS n_channels, ({WAVE_BITS})::INTEGER AS bits, {WAVE_N}::BIGINT AS n_frames "
        "FROM events), s AS (SELECT *, n_frames::DOUBLE / sample_rate AS secs FROM h) "
        "SELECT utt_id, sample_rate, n_channels, bits, n_frames, round(secs, 6) AS seconds, "
        "array_to_string(list_filter([CASE WHEN sample_rate < 16000 THEN 'low_sample_rate' END, "
        "CASE WHEN secs > 10.0 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS flags FROM s"
    ),
    "audio_roundtrip": (
        "WITH h AS (SELECT event_id AS utt_id, (1 + event_id % 50)::BIGINT AS n_frames, "
        "CASE event_id % 8 WHEN 0 THEN 'mp3' WHEN 1 THEN 'opus' WHEN 2 THEN 'aac' WHEN 3 THEN 'flac' "
        "WHEN 4 THEN 'wav' WHEN 5 THEN 'pcm' WHEN 6 THEN 'ogg' ELSE NULL END AS fmt FROM events) "
        "SELECT utt_id, 16000 AS sample_rate, 1 AS n_channels, 16 AS bits, n_frames, "
        "CASE WHEN fmt = 'mp3' THEN 'audio/mpeg' ELSE 'audio/wav' END AS content_type, "
        "'attachment; filename=speech.' || fmt AS content_disposition, "
        "(n_frames // 320)::BIGINT AS generated_tokens, round(n_frames / 16000.0, 6) AS audio_duration FROM h"
    ),
    "stream_manifest_last_wins": f"WITH {LINES}, {PARSED}, {DEDUP} SELECT file_id, text, first_key, n_lines FROM dedup",
    "stream_training_prompt": (
        f"WITH {SENT} SELECT conv_id, turn, {G.prompt('text', 'codes')} AS prompt FROM sent"
    ),
}
ORACLE_SQL["stream_segment_stitch"] = ORACLE_SQL["segment_stitch"]
