"""DuckDB oracle support: the fixture views as CTE text.

The driver registers only the base tables, so every oracle statement inlines
the views it needs (in dependency order) as a ``WITH`` clause.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "http_raw": ([], """
select e.event_id + 1 as original_index,
  case when e.event_id % 97 = 0 then null when e.event_type in ('purchase','signup') then 'POST' else 'GET' end as request_http_method,
  regexp_extract(p.url, '^[a-z]+://[^/]+(/[^#]*)', 1) ||
    case when e.event_type = 'error' and e.event_id % 3 = 0 then '/../../etc/passwd'
         when e.event_type = 'error' and e.event_id % 3 = 1 then '?id=1+ORDER+BY+3'
         when e.event_type <> 'error' and e.event_id % 53 = 0 then '/.git/config'
         when e.event_type <> 'error' and e.event_id % 59 = 0 then '/index.bak'
         else '' end as request_http_request,
  'HTTP/1.1' as request_http_protocol,
  regexp_extract(p.url, '^[a-z]+://([^/]+)', 1) as request_host,
  'agent/' || cast(e.user_id % 5 as varchar) as request_user_agent,
  case when e.event_id % 2 = 0 then 'text/html' end as request_accept,
  case when e.event_id % 7 = 0 then p.url end as request_referer,
  'uid=' || cast(e.user_id as varchar) as request_cookie,
  case when e.event_type in ('purchase','signup') then e.props when e.event_id % 11 = 0 then '' end as request_body,
  case when e.event_type = 'error' then 0 else 1 end as is_normal,
  case when e.event_type = 'error' and e.event_id % 29 <> 0 and e.event_id % 13 = 0 then 1 else 0 end as c01,
  case when e.event_type = 'error' and e.event_id % 29 <> 0 and e.event_id % 13 in (1,2,3,4,5) then 1 else 0 end as c04,
  case when e.event_type = 'error' and e.event_id % 29 <> 0 and e.event_id % 13 in (5,6,7,8) then 1 else 0 end as c05,
  case when e.event_type = 'error' and e.event_id % 29 <> 0 and e.event_id % 13 >= 8 then 1 else 0 end as c13,
  e.value / 500 as loss
from (select ev.*, ev.event_id % c.n as page_no
      from events ev cross join (select count(*) as n from pages) c) e
join pages p on p.page_id = e.page_no"""),
    "requests": (["http_raw"], """
select original_index, 1 - is_normal as anomalous,
  case when is_normal = 1 then 'normal' when c01 = 1 then '272 - Protocol Manipulation' when c04 = 1 then '126 - Path Traversal'
       when c05 = 1 then '66 - SQL Injection' when c13 = 1 then '33 - HTTP Request Smuggling' else 'normal' end as ano_class,
  concat_ws('[r][n]', concat_ws(' ', request_http_method, request_http_request, request_http_protocol),
    'Host: ' || nullif(request_host, ''), 'User-Agent: ' || request_user_agent, 'Accept: ' || request_accept,
    'Referer: ' || request_referer, 'Cookie: ' || request_cookie, '', nullif(request_body, '')) as request
from http_raw
where request_http_method is not null and request_http_request is not null and request_http_protocol is not null"""),
    "predictions": ([], """
select event_id + 1 as original_index, value / 500 as loss, exp(value / 500) as perplexity from events"""),
    "split_keys": (["requests"], """
select original_index, anomalous, md5('42|' || cast(original_index as varchar)) as shuffle_key from requests"""),
    "doc_requests": ([], """
select d.doc_id as original_index, coalesce(l.toxic, 0) as anomalous, d.source as ano_class, d.text as request
from documents d left join labels l on l.doc_id = d.doc_id"""),
    "token_logits": ([], """
select vec_id - vec_id % 10 as original_index, vec_id % 10 as pos, embedding as logits, label from embeddings"""),
    "train_log": ([], """
select user_id as run, max(ts) over (partition by user_id) as mtime, event_type as tag, event_id as step, value from events"""),
    "timings": ([], """
select l_orderkey as original_index, l_quantity / 1000 as time_taken, l_linenumber as tokens_count from lineitem"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for ``views`` (and their dependencies) plus
    any ``extra`` (name, sql) pairs, which may refer to the views."""
    ctes = [f"{n} as ({VIEWS[n][1]}\n)" for n in _order(list(views))]
    ctes += [f"{n} as ({sql}\n)" for n, sql in (extra or [])]
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body


def sql_str(s: str) -> str:
    """SQL string literal (standard SQL: only the quote is doubled)."""
    return "'" + s.replace("'", "''") + "'"
