"""The contract queries, one an operator, and their SQL where SQL can express them."""

from __future__ import annotations

from loomseq.llm.bpe import op10_bpe
from loomseq.llm.chat import op9_chat
from loomseq.llm.decontam import op7_decontaminate
from loomseq.llm.langid import op8_langid
from loomseq.llm.lm import op4_lm
from loomseq.llm.minhash import op2_minhash
from loomseq.llm.quality import op5_quality
from loomseq.llm.simhash import op6_simhash
from loomseq.llm.substring import op3_substring
from loomseq.llm.warc import op1_warc

QUERIES = {"op4_lm": op4_lm, "op7_decontaminate": op7_decontaminate, "op2_minhash": op2_minhash, "op5_quality": op5_quality, "op8_langid": op8_langid, "op1_warc": op1_warc, "op3_substring": op3_substring, "op6_simhash": op6_simhash, "op9_chat": op9_chat, "op10_bpe": op10_bpe}

#: base32 by 5 bits: each 5 hexadecimal digits of the SHA-1 are 4 characters.
WARC_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as least from pages),
d as (
  select page_id, payload_bytes, least, array_to_string(list_transform(list_transform(range(8), lambda g: cast('0x' || substr(h, 5 * g + 1, 5) as integer)),
    lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') as payload_digest,
    least is not null and least is distinct from page_id as again from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then least end as refers_to from d
"""

SUBSTRING_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w),
f as (select doc_id, s, row_number() over (partition by array_to_string(ws[s:s + 19], ' ') order by doc_id, s) as r from p),
c as (select distinct doc_id, unnest(range(s, s + 20)) as pos from f where r > 1),
n as (select doc_id, count(*) as n_removed from c group by doc_id),
a as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
k as (select doc_id, string_agg(word, ' ' order by pos) as kept from a anti join c using (doc_id, pos) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join n on w.doc_id = n.doc_id left join k on w.doc_id = k.doc_id
"""

CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), '') as state from t),
v as (
  select *, case state when '' then role in ('system', 'user') when 'system' then role = 'user' when 'user' then role = 'assistant'
      when 'assistant' then role in ('user', 'tool') when 'tool' then role in ('assistant', 'tool') else false end as ok,
    length(text) + length(role) + length(regexp_replace(text || role, '[^\\<]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')) as size from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  cast(sum(size + length('<|im_start|>') + length('<|im_end|>') + 2) as bigint) as formatted_chars,
  bool_and(ok) and max_by(role, k) = 'assistant' as valid
from v group by conv_id
"""

ORACLES = {"op1_warc": WARC_SQL, "op3_substring": SUBSTRING_SQL, "op9_chat": CHAT_SQL}
