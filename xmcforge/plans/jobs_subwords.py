"""Subword vocabulary and ids."""

from __future__ import annotations

from xmcforge.functions import subwords as SW
from xmcforge.functions import text as TX
from xmcforge.plans import fixtures as fx
from xmcforge.plans.registry import job
from xmcforge.session import reliable_checkpoint

MIN_COUNT = 3

WORDS_SQL = f"""
select row_id, unnest(range(1, len(w) + 1)) as word_pos, unnest(w) as word
from (select row_id, regexp_extract_all(lower(coalesce(text, '')), '{TX.TOKEN_PATTERN}') as w from fx_doc_text)"""

PIECES_SQL = f"""
select token, cast(count(*) as bigint) as count,
       cast(row_number() over (order by count(*) desc, token) + {TX.FIRST_TOKEN_ID - 1} as bigint) as token_id
from (select word as token from ({WORDS_SQL}) where length(word) between 2 and {SW.MAX_PIECE}
        and word in (select word from ({WORDS_SQL}) group by word having count(*) >= {MIN_COUNT})
      union all select unnest(regexp_extract_all(word, '.')) from ({WORDS_SQL}))
group by token"""

SUBWORDS_SQL = f"""
select * from (with recursive vocab as materialized ({PIECES_SQL}),
rows as materialized ({WORDS_SQL}),
distinct_words as (select distinct word from rows),
starts as (select word, unnest(range(1, length(word) + 1)) as place from distinct_words),
longest as materialized (
  select s.word, s.place, coalesce(max(length(v.token)), 1) as size, coalesce(arg_max(v.token_id, length(v.token)), {TX.UNK_ID}) as token_id
  from (select word, place, unnest(range(1, least({SW.MAX_PIECE}, length(word) - place + 1) + 1)) as n from starts) s
  left join vocab v on v.token = substr(s.word, s.place, s.n)
  group by s.word, s.place),
reading as (
  select word, place, size, token_id, 0::bigint as piece_pos from longest where place = 1
  union all
  select l.word, l.place, l.size, l.token_id, r.piece_pos + 1 from reading r join longest l on l.word = r.word and l.place = r.place + r.size)
select row_id, cast(word_pos as bigint) as word_pos, piece_pos, cast(token_id as bigint) as token_id
from rows join reading using (word)
union all select row_id, 0, 0, {TX.BOS_ID} from fx_doc_text
union all select d.row_id, cast(coalesce(m.n, 0) + 1 as bigint), 0, {TX.EOS_ID}
from fx_doc_text d left join (select row_id, max(word_pos) as n from rows group by row_id) m on m.row_id = d.row_id)"""


@job("build_subword_vocab", oracle=PIECES_SQL)
def build_subword_vocab(t):
    """Frequent words and all characters of the whole document corpus, ranked by frequency."""
    return SW.piece_vocab(fx.doc_text(t), min_count=MIN_COUNT)


@job("tokenize_subwords", oracle=SUBWORDS_SQL)
def tokenize_subwords(t):
    """Every document's words as the longest pieces of the vocabulary, with BOS and EOS."""
    corpus = fx.doc_text(t)
    words = reliable_checkpoint(SW.word_counts(corpus, key="row_id"))
    return SW.subword_sequence(corpus, SW.piece_vocab(corpus, min_count=MIN_COUNT, words=words), words=words)
