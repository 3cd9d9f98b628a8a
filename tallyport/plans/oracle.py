"""Oracle SQL (DuckDB) of the catalogue."""

SQL = {
    "accumulate_commit": r"""
        select user_id, max(case when event_type='click' then event_id end) a, max(case when event_type='purchase' then event_id end) b from events group
        by user_id having count(case when event_type='click' then 1 end)>0 and count(case when event_type='purchase' then 1 end)>0
    """,
    "assume_override": r"""
        select distinct l_partkey k from lineitem l where not exists (select 1 from (values (1),(5),(9),(100)) h(v) where h.v=l.l_partkey)
    """,
    "blob_inventory": r"""
        select doc_id,'sha256:'||sha256(text) digest, cast(octet_length(encode(text)) as bigint) size from documents
    """,
    "chunk_layout": r"""
        select doc_id,i,'blobs/sha256/'||sha256(text)||'/'||lpad(cast(i as varchar),8,'0') as name, least(1000, sz-i*1000) len from (select doc_id,text,cast(octet_length(encode(text))
        as bigint) sz, unnest(range(0,greatest((octet_length(encode(text))+999)//1000,1))) i from documents)
    """,
    "chunk_size_parse": r"""
        select p_partkey, s, case when regexp_extract(s,'^([0-9]+)(GiB|MiB|KiB|GB|MB|KB|G|M|K|B)?$',1)='' then null else cast(nullif(regexp_extract(s,'^([0-9]+)(GiB|MiB|KiB|GB|MB|KB|G|M|K|B)?$',1),'')
        as bigint) * case regexp_extract(s,'^([0-9]+)(GiB|MiB|KiB|GB|MB|KB|G|M|K|B)?$',2) when 'GiB' then 1073741824 when 'G' then 1073741824 when 'MiB'
        then 1048576 when 'M' then 1048576 when 'KiB' then 1024 when 'K' then 1024 when 'GB' then 1000000000 when 'MB' then 1000000 when 'KB' then 1000
        else 1 end end bytes from (select p_partkey, concat(cast(p_size as string), case p_partkey%12 when 0 then 'GiB' when 1 then 'MiB' when 2 then
        'KiB' when 3 then 'GB' when 4 then 'MB' when 5 then 'KB' when 6 then 'G' when 7 then 'M' when 8 then 'K' when 9 then 'B' when 10 then '' else
        'Gi' end) s from part) t
    """,
    "complete_blobs": r"""
        select conv_id, bool_and(length(text)>=20) complete from conversations group by conv_id
    """,
    "config_overlay": r"""
        select d.doc_id, coalesce(case when l.quality=1 then 'env' end, case when d.lang='en' then 'file' end, 'default') layer from documents d left
        join labels l on d.doc_id=l.doc_id
    """,
    "dangling_audit": r"""
        select l_orderkey img, count(distinct l_partkey) missing from lineitem l where not exists (select 1 from part p where p.p_partkey=l.l_partkey
        and p.p_size<40) group by l_orderkey
    """,
    "dry_run_vs_real": r"""
        select img, count(*) dry_sent, cast(sum(case when rn=1 then 1 else 0 end) as bigint) real_sent from (select img,k,row_number() over (partition
        by k order by img) rn from (select distinct l_orderkey img,l_partkey k from lineitem) a) b group by img
    """,
    "endpoint_parts": r"""
        select page_id, regexp_extract(url,'^https?://([^/?#]+)',1) host, regexp_extract(url,'^https?://[^/?#]+/([^?#]*)',1) path from pages
    """,
    "fail_fast_cut": r"""
        select event_id from (select event_id, sum(case when event_type='error' then 1 else 0 end) over (partition by user_id order by ts,event_id rows
        between unbounded preceding and 1 preceding) f from events) where coalesce(f,0)=0
    """,
    "first_occurrence": r"""
        select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by event_id) rn from events) where
        rn=1
    """,
    "have_union": r"""
        select l_partkey k from lineitem union select cast(p_size as bigint) from part union select s_suppkey from supplier
    """,
    "json_field": r"""
        select event_id, cast(json_extract_string(props,'$.k') as bigint) k from events
    """,
    "latest_meta": r"""
        select user_id, arg_max(value, row(ts,event_id)) v from events group by user_id
    """,
    "marker_path_parse": r"""
        select c_custkey, regexp_extract(p,'^([^/]+)/(.+?)/(_tags|_digests)/([^/]+)$',1) host, regexp_extract(p,'^([^/]+)/(.+?)/(_tags|_digests)/([^/]+)$',2)
        repo, regexp_extract(p,'^([^/]+)/(.+?)/(_tags|_digests)/([^/]+)$',4) leaf from (select c_custkey, concat('reg.io/',lower(c_mktsegment),'/n',cast(c_nationkey
        as string),'/_tags/v',cast(c_custkey as string)) p from customer) t
    """,
    "plan_order": r"""
        select l_orderkey img, cast(row_number() over (partition by l_orderkey order by k) as bigint) ordinal, k from (select distinct l_orderkey, cast(l_partkey
        as string) k from lineitem) x
    """,
    "pool_dedup": r"""
        select 'sha256:'||sha256(text) digest, count(*) copies, cast(sum(octet_length(encode(text)))-max(octet_length(encode(text))) as bigint) saved,
        min(doc_id) first_doc from documents group by 1
    """,
    "push_report": r"""
        with have as (select distinct l_partkey k from lineitem where l_returnflag = 'N'), need as (select distinct l_orderkey img,l_partkey k, cast(l_partkey%97+1
        as bigint) sz from lineitem where l_returnflag <> 'N') select img, cast(sum(case when h.k is null then 1 else 0 end) as bigint) sent, cast(sum(case
        when h.k is null then 0 else 1 end) as bigint) reused, cast(sum(case when h.k is null then sz else 0 end) as bigint) bytes from need n left join
        have h on n.k=h.k group by img
    """,
    "redact_url": r"""
        select page_id, regexp_replace(regexp_replace(url,'[?#].*$',''),'://[^/@]*@','://') u from pages
    """,
    "ref_parse": r"""
        with raw as (select page_id i, concat(substr(regexp_extract(url,'^https?://([^?#]*)',1),1), case page_id%9 when 0 then '' when 1 then concat(':v',cast(page_id
        as string)) when 2 then ':.bad' when 3 then concat('@sha256:',repeat('a',64)) when 4 then '@deadbeef' when 5 then '/_tags/x:1' when 6 then '/../x'
        when 7 then ':' else ':Tag-1_2.3' end) s from pages union all select 1000000+p_partkey, case p_partkey%6 when 0 then replace(p_name,' ','-')
        when 1 then concat('DOCKER.IO/',replace(p_name,' ','/')) when 2 then concat('LOCALHOST/',cast(p_partkey as string)) when 3 then concat('localhost:',cast(p_size
        as string)) when 4 then concat('nginx:1.0@sha256:',repeat('b',64)) else concat('reg.io:5000/',replace(p_name,' ','/'),':',cast(p_size as string))
        end from part), a as (select i,s, regexp_extract(s,'@([^@]*)$',1) dpart, case when regexp_extract(s,'(@)',1)='' then 0 else 1 end hasd, case
        when regexp_extract(s,'(@)',1)='' then s else substr(s,1,length(s)-length(regexp_extract(s,'@([^@]*)$',1))-1) end r from raw), b as (select *,
        case when hasd=0 and regexp_extract(r,'^(?:.*/)?[^/:]*(:)[^/]*$',1)<>'' then 1 else 0 end hastag, case when hasd=0 then regexp_extract(r,'^(?:.*/)?[^/:]*:([^/]*)$',1)
        else '' end tag0 from a), c as (select *, case when hastag=1 then substr(r,1,length(r)-length(tag0)-1) else r end n from b), e as (select *,
        regexp_extract(n,'^([^/]*)/',1) first_seg, case when regexp_extract(n,'(/)',1)<>'' and (regexp_extract(n,'^([^/]*)/',1)='localhost' or regexp_extract(regexp_extract(n,'^([^/]*)/',1),'([.:])',1)<>'')
        then 1 else 0 end hh from c), f as (select *, lower(case when hh=1 then first_seg else 'docker.io' end) host, case when hh=1 then substr(n,length(first_seg)+2)
        else n end p0 from e), g as (select *, case when host='docker.io' and regexp_extract(p0,'(/)',1)='' then concat('library/',p0) else p0 end path,
        case when hasd=0 and hastag=0 then 'latest' else tag0 end tag from f), v as (select i, s, host, path, tag, case when hasd=1 then regexp_extract(dpart,'^sha256:([0-9a-f]{64})$',1)
        else '' end digest_hex, case when s='' then 'empty reference' when hasd=1 and regexp_extract(dpart,'^(sha256:)',1)='' then 'digest prefix' when
        hasd=1 and regexp_extract(dpart,'^sha256:([0-9a-f]{64})$',1)='' then 'digest hex' when hastag=1 and tag0='' then 'empty tag' when n='' then 'missing path'
        when host in ('','.','..') then 'host' when path='' then 'missing path' when regexp_extract(concat('/',path,'/'),'(//)',1)<>'' then 'empty segment'
        when regexp_extract(concat('/',path,'/'),'/(_tags|_digests)/',1)<>'' then 'reserved segment' when regexp_extract(concat('/',path,'/'),'/([.]|[.][.])/',1)<>''
        then 'path traversal' when length(tag)>128 then 'tag too long' when tag<>'' and regexp_extract(tag,'^([A-Za-z0-9_])',1)='' then 'tag start' when
        tag<>'' and regexp_extract(tag,'^([A-Za-z0-9_][A-Za-z0-9._-]*)$',1)='' then 'tag char' else '' end error from g) select i, case when error=''
        then case when digest_hex<>'' then concat(host,'/',path,'@sha256:',digest_hex) else concat(host,'/',path,':',tag) end else '' end canonical,
        error from v
    """,
    "resume_offset": r"""
        with t as (select conv_id, turn+turn//3 turn, length(text) len from conversations), r as (select *, row_number() over (partition
        by conv_id order by turn)-1 rn from t) select conv_id, cast(sum(case when turn=rn then len else 0 end) as bigint) resume_offset, cast(count(*)
        as bigint) present from r group by conv_id
    """,
    "size_lookup": r"""
        select p.p_partkey, coalesce(s.sz,0) sz from part p left join (select l_partkey, sz from (select l_partkey, cast(l_quantity as bigint)-10 sz,
        row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc) rn from lineitem where
        l_quantity>10) x where rn=1) s on s.l_partkey=p.p_partkey
    """,
    "skip_bad_items": r"""
        select event_id,k from (select event_id, try_cast(try_cast(case when event_id%7=0 then '{bad' else props end as json)->>'$.k' as bigint) k from
        events) where k is not null
    """,
    "summary_line": r"""
        select l_orderkey, format('{} pushed (new: {}, reused: {}, bytes: {})', l_orderkey, count(*), 0, cast(sum(l_quantity) as bigint)) line from lineitem
        group by l_orderkey
    """,
    "transfer_plan": r"""
        with need as (select distinct l_partkey k from lineitem where l_returnflag='R'), have as (select distinct l_partkey k from lineitem where l_returnflag='N'), pinned as (select distinct p_partkey k from part where p_size=1) select k from pinned union select n.k from need n where
        not exists (select 1 from have h where h.k=n.k)
    """,
}
