"""DuckDB SQL that means the same as the catalogue's queries, one for each name."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "text_contains": r"""SELECT doc_id, lang FROM documents WHERE contains(text,'the')""",
    "text_contains_icase": r"""SELECT doc_id FROM documents WHERE contains(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'the')""",
    "text_regex": r"""SELECT doc_id FROM documents WHERE regexp_matches(text,'[0-9]{3}')""",
    "text_whole_word_first": r"""SELECT doc_id, strpos(text,'the') AS pos FROM documents WHERE strpos(text,'the')>0 AND (strpos(text,'the')=1 OR regexp_matches(substr(text,strpos(text,'the')-1,1),'^[\s!-/:-@\[-`{-~]$'))
        AND (strpos(text,'the')+3>length(text) OR regexp_matches(substr(text,strpos(text,'the')+3,1),'^[\s!-/:-@\[-`{-~]$'))""",
    "text_extract_substring": r"""SELECT doc_id, strpos(text,'and') AS pos, substr(text,strpos(text,'and'),3) AS hit FROM documents WHERE strpos(text,'and')>0""",
    "tokenize_words": r"""SELECT doc_id, tok FROM (SELECT doc_id, unnest(regexp_split_to_array(text,'[ \t\n\r\f]+')) AS tok FROM documents) WHERE tok<>''""",
    "token_counts": r"""SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text,'[ \t\n\r\f]+')) AS tok FROM documents)
        WHERE tok<>'' GROUP BY lang, tok""",
    "trim_entries": r"""SELECT doc_id, ln FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(text,chr(10))),'^[ \t\r\f]+',''),'[ \t\r\f]+$','')
        AS ln FROM documents) WHERE ln<>''""",
    "line_numbering": r"""SELECT doc_id, unnest(range(1,len(lines)+1)) AS line_no, unnest(lines) AS ln FROM (SELECT doc_id, string_split(text,chr(10))
        AS lines FROM documents)""",
    "gap_entries": r"""SELECT user_id, event_id, CAST(sum(CASE WHEN prev IS NULL OR ts-prev > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION
        BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM (SELECT *, lag(ts) OVER (PARTITION BY
        user_id ORDER BY ts, event_id) AS prev FROM events)""",
    "gap_class": r"""SELECT event_id, CASE WHEN g IS NULL THEN 'first' WHEN g>6*3600 THEN 'hard' WHEN g>=3600 THEN 'soft' ELSE 'none' END AS sep
        FROM (SELECT event_id, epoch_us(ts)/1000000 - lag(epoch_us(ts)/1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id)
        AS g FROM events)""",
    "entry_concat": r"""SELECT conv_id, string_agg(text,' ' ORDER BY turn) AS txt FROM conversations GROUP BY conv_id""",
    "pen_position": r"""SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
        PRECEDING),0) AS BIGINT) AS x FROM documents""",
    "state_depth": r"""SELECT event_id, CAST(sum(CASE WHEN value>=50 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED
        PRECEDING) AS BIGINT) AS depth FROM events""",
    "clip_rect": r"""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500""",
    "ref_resolve": r"""SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey=c_custkey""",
    "ref_must_resolve": r"""SELECT l_orderkey,l_linenumber,p_name FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "inherit_key": r"""SELECT c_custkey, coalesce(CASE WHEN c_acctbal<0 THEN NULL ELSE c_mktsegment END, n_name, r_name) AS v FROM customer LEFT
        JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey""",
    "full_name": r"""SELECT n_nationkey, replace(r_name,'.','..')||'.'||replace(n_name,'.','..') AS full_name FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "reachable_objects": r"""WITH RECURSIVE e AS (SELECT 'r'||r_regionkey AS s,'n'||n_nationkey AS d FROM nation JOIN region ON n_regionkey=r_regionkey
        UNION ALL SELECT 'n'||c_nationkey,'c'||c_custkey FROM customer), r(id) AS (SELECT 'r0' UNION SELECT e.d FROM r JOIN e ON e.s=r.id)
        SELECT id FROM r""",
    "garbage_objects": r"""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_quantity>45)""",
    "xref_semi": r"""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R')""",
    "xref_latest_wins": r"""SELECT o_custkey,o_orderkey,o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
        o_orderkey DESC) AS rn FROM orders) WHERE rn=1""",
    "trailer_merge": r"""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS prio FROM orders GROUP BY o_custkey""",
    "info_xmp_merge": r"""SELECT coalesce(d.doc_id,l.doc_id) AS doc_id, coalesce(l.quality,-1) AS quality, coalesce(d.source,'?') AS source FROM documents
        d FULL JOIN labels l ON d.doc_id=l.doc_id""",
    "page_ordinal": r"""SELECT page_id, row_number() OVER (ORDER BY page_id)-1 AS page_index FROM pages""",
    "page_slice": r"""SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id)-1 AS i FROM pages) WHERE i>=10 AND i<15""",
    "merge_rebase": r"""SELECT n_nationkey AS id, n_name FROM nation UNION ALL SELECT n_nationkey+(SELECT max(n_nationkey)+1 FROM nation), n_name
        FROM nation""",
    "delete_page_renumber": r"""SELECT page_id, row_number() OVER (ORDER BY page_id)-1 AS i FROM pages WHERE page_id<>3""",
    "sibling_links": r"""SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION
        BY conv_id ORDER BY turn)""",
    "xref_blocks": r"""SELECT min(k) AS first, count(*) AS cnt FROM (SELECT o_orderkey AS k, o_orderkey-row_number() OVER (ORDER BY o_orderkey) AS
        g FROM orders WHERE o_totalprice>100000) GROUP BY g""",
    "width_runs": r"""SELECT o_custkey, CAST(run AS BIGINT) AS run, min(o_orderkey) AS a, max(o_orderkey) AS b, min(o_orderstatus) AS v FROM (SELECT
        *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN o_orderstatus
        IS NOT DISTINCT FROM lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS ch FROM orders))
        GROUP BY o_custkey, run""",
    "node_limits": r"""SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand""",
    "name_lookup": r"""SELECT c_custkey, c_name FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000020'""",
    "range_expand": r"""SELECT n_nationkey, unnest(range(n_nationkey, n_nationkey+3)) AS code FROM nation""",
    "hex_encode": r"""SELECT r_regionkey, hex(encode(r_name)) AS h FROM region""",
    "file_identifier": r"""SELECT doc_id, md5(source||'|'||lang||'|'||CAST(n_chars AS VARCHAR)) AS ident FROM documents""",
    "pdf_date_format": r"""SELECT o_orderkey, 'D:'||strftime(o_orderdate,'%Y%m%d%H%M%S') AS d FROM orders""",
    "pdf_date_parse": r"""SELECT o_orderkey, o_orderdate - INTERVAL 1 HOUR AS utc FROM orders""",
    "flag_bits": r"""SELECT p_partkey, (p_size & 4)<>0 AS can_print, (p_size & 16)<>0 AS can_copy FROM part""",
    "field_type": r"""SELECT p_partkey, CASE WHEN p_size & 16 <> 0 THEN 'PushButton' WHEN p_size & 8 <> 0 THEN 'RadioButton' ELSE 'CheckBox' END
        AS ft FROM part""",
    "box_fallback": r"""SELECT p_partkey, coalesce(CASE WHEN p_size>40 THEN p_size END, CASE WHEN p_size>20 THEN p_size*2 END, p_size*3) AS box FROM
        part""",
    "color_gray": r"""SELECT l_orderkey,l_linenumber, 0.299::DOUBLE*l_discount+0.587::DOUBLE*l_tax+0.114::DOUBLE*(l_quantity/50) AS gray FROM lineitem""",
    "rgb_to_cmyk": r"""SELECT l_orderkey,l_linenumber, least(1-l_discount,1-l_tax,1-l_quantity/50) AS k FROM lineitem""",
    "affine_point": r"""SELECT p_partkey, p_size*2.0::DOUBLE+p_retailprice*0.5::DOUBLE+10 AS x, p_size*(-0.5::DOUBLE)+p_retailprice*2.0::DOUBLE+20
        AS y FROM part""",
    "keywords_split": r"""WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text,''),'[^\r\n]*[\r\n]|[^\r\n]+$') AS k FROM documents) SELECT doc_id, len(k) AS n, k[1] AS first FROM k""",
    "annotation_enumerate": r"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS idx, role FROM conversations""",
    "sorted_dictionary": r"""SELECT n_regionkey, string_agg(n_name,',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""",
    "props_get": r"""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props,'$.k') AS BIGINT),-1) AS k FROM events""",
    "html_text": r"""SELECT page_id, length(regexp_replace(html,'<[^>]*>','','g')) AS n FROM pages""",
    "html_title": r"""SELECT page_id, regexp_extract(html,'<title>([^<]*)</title>',1) AS title FROM pages""",
    "link_destinations": r"""SELECT page_id, unnest(regexp_extract_all(html,'href="([^"]*)"',1)) AS uri FROM pages""",
    "frame_rotated": r"""SELECT p_partkey, CAST(round(100*CASE p_size%4 WHEN 0 THEN p_size WHEN 1 THEN 830-p_retailprice WHEN 2 THEN 620-p_size ELSE p_retailprice-10 END) AS BIGINT) AS x,
        CAST(round(100*CASE p_size%4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size+10 WHEN 2 THEN 840-p_retailprice ELSE 630-p_size END) AS BIGINT) AS y, true AS back FROM part""",
    "vector_lengths": r"""SELECT p_partkey, CAST(5*p_size AS BIGINT) AS length FROM part""",
    "products_overflow": r"""SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS HUGEINT)*1125899906842624 > 9223372036854775807 AS over FROM lineitem""",
    "endian_round_trip": r"""SELECT o_orderkey, lpad(printf('%X',o_orderkey),8,'0') AS raw, CAST(o_orderkey AS BIGINT) AS again FROM orders""",
    "color_hex": r"""WITH c AS (SELECT p_partkey, CAST(p_partkey AS BIGINT)*7919%16777216 AS c FROM part) SELECT p_partkey, 'DeviceRGB' AS space, c//65536 AS r, c//256%256 AS g, c%256 AS b FROM c""",
    "font_base_names": r"""SELECT p_partkey, replace(p_name,' ','') AS name, p_partkey%5 IN (2,3,4) AS italic, p_partkey%5 IN (1,3) AS bold FROM part""",
    "doc_encodable": r"""SELECT doc_id, regexp_full_match(coalesce(text,''),'[\x00-\x17\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{FF}˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€]*') AS doc,
        regexp_full_match(coalesce(text,''),'[\x00-\x7F]*') AS ascii, true AS valid FROM documents""",
    "dictionary_edits": r"""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(c_custkey AS VARCHAR) AS c FROM customer""",
    "array_edits": r"""SELECT c_custkey, '[7,'||c_custkey||',[1],"end"]' AS edited, CAST(c_custkey AS VARCHAR) AS second, '[7,'||c_custkey||']' AS cut, '['||c_custkey||',"x",null,null]' AS filled FROM customer""",
}
