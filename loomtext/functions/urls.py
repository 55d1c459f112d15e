"""Parts of URLs as built-in expressions, with a documented subset of the public suffix list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels that this subset knows; others have the last label as their suffix.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp com.br net.br org.br co.in net.in org.in com.mx com.cn net.cn org.cn co.za com.tr com.sg com.hk co.kr or.kr com.ar com.tw".split()


def hostname(url: Column) -> Column:
    """Host in lower case, without scheme, user, port, path; null if there is none. An @ counts to the end of the authority alone."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def is_ip(host: Column) -> Column:
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return host.rlike(rf"^({part}\.){{3}}{part}$") | host.rlike(r"^\[[0-9a-f:.]+\]$")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that is only nested would be repeated wherever it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(host: Column, ip: Column, labels: Column) -> Column:
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    long = F.coalesce((n >= 2) & two.isin(TWO_LABEL_SUFFIXES), F.lit(False))
    taken = F.when(ip | labels.isNull(), F.lit(None).cast("int")).when(long, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    has = n > taken
    return F.struct(
        host.alias("hostname"), ip.alias("is_ip"), F.when(taken.isNotNull(), last(taken)).alias("public_suffix"), F.when(has, last(taken + 1)).alias("domain"),
        F.when(has, F.get(labels, n - taken - 1)).alias("domain_without_suffix"),
        F.when(has, F.array_join(F.slice(labels, F.lit(1), F.greatest(n - taken - 1, F.lit(0))), ".")).alias("subdomain"),
    )


def parse(url: Column) -> Column:
    """Struct of hostname, is_ip, public_suffix, domain, domain_without_suffix and subdomain."""
    of_host = lambda h: _let(F.struct(h.alias("h"), F.coalesce(is_ip(h), F.lit(False)).alias("ip"), F.split(h, r"\.").alias("l")), lambda x: _parts(x["h"], x["ip"], x["l"]))
    return F.when(url.isNotNull(), _let(hostname(url), of_host))
