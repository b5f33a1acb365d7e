"""Every query of the library and its SQL."""

from __future__ import annotations

from tallgrass.plans.fixtures import FIXTURES
from tallgrass.plans.hosted import HOSTED
from tallgrass.plans.relational import PLANS
from tallgrass.sources.hosts import Hosts, with_views

QUERIES = {name: (lambda spark, sf_dir, f=f: f(Hosts(spark, sf_dir))) for name, (f, _) in (PLANS | HOSTED).items()}
QUERIES |= {name: (lambda spark, sf_dir, f=f: f(spark)) for name, (f, _) in FIXTURES.items()}
ORACLES = {name: with_views(sql) for name, (_, sql) in (PLANS | HOSTED).items() if sql}
ORACLES |= {name: sql for name, (_, sql) in FIXTURES.items() if sql}
