"""The keyword profile of the registered queries: topics of notes, and the repositories in which their code is searched."""

from __future__ import annotations

from ..operators.topics import Topic

PROFILE = [
    Topic("delivery", "Delivery", ("ion", "loaditem"), ("src1", "src2")),
    Topic("billing", "Billing", ("eau", "ent", "accounts_"), ("src0", "src3", "src4")),
    Topic("access", "Access", ("password", "sch", "innerhtml"), ("src5",)),
    Topic("search", "Search", ("ción", "ado", "class model"), ("src6", "src7")),
    Topic("platform", "Platform", ("ci", "api", "zz"), ()),
    Topic("legacy", "Legacy", ("gitlab", "old pages"), ("src99",)),
]
