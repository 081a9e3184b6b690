"""Facts from schema SQL."""

import pytest

from sparkpact.source import SourceError
from sparkpact.sources.schema_sql import schema_from_sql
from sparkpact.statement import ContractError, Statement

BASE = """
-- accounts and what they post
create type account_status as enum ('active', 'it''s off');
create domain short_code as varchar(8) not null check (value in ('x', 'y'));
create domain app.free as text;
create table accounts (
  id bigint generated always as identity primary key,
  public_id uuid not null default gen_random_uuid(),
  email text not null unique,
  display_name text,
  status account_status not null default 'active',
  role text not null check (role in ('member', 'admin')),
  balance numeric(12, 2), tags text[], "Odd Name" varchar(20), point geometry,
  code short_code, remark app.free default 'none', codes short_code[],
  created_at timestamptz not null default now()
);
create table if not exists app.posts (
  id bigint primary key, account_id bigint not null references accounts (id) on delete cascade, title text not null, body text,
  kind text constraint kind_check check (kind = 'a' or kind = 'b') check (kind in ('b', 'c')),
  constraint posts_title unique (account_id, title), unique (body) deferrable initially deferred,
  check (title <> body), check (body = any (array['x'::text])) no inherit
);
create unique index posts_partial on app.posts (title) where body is not null;
create unique index posts_lower on app.posts (lower(title));
create unique index posts_body on app.posts using btree (body);
alter table only app.posts add constraint late check (title in ('p', 'q')) not valid;
alter table app.posts add constraint soon check (title in ('p', 'q', 'r'));
create view published as select 1;
"""


def test_facts():
    s = schema_from_sql(BASE)
    a, p = s["accounts"], s["posts"]
    assert list(a.types.items()) == [("id", "bigint"), ("public_id", "string"), ("email", "string"), ("display_name", "string"), ("status", "string"), ("role", "string"), ("balance", "decimal(12,2)"),
                                     ("tags", "array<string>"), ("Odd Name", "string"), ("point", "unknown"), ("code", "string"), ("remark", "string"), ("codes", "unknown"), ("created_at", "timestamp")]
    assert a.not_null == {"id", "public_id", "email", "status", "role", "code", "created_at"}
    assert {(k.name, k.columns, k.primary) for k in a.keys} == {("accounts_pkey", ("id",), True), ("accounts_email_key", ("email",), False)}
    assert a.allowed == {"status": ("active", "it's off"), "role": ("member", "admin"), "code": ("x", "y")}
    assert {k.columns for k in p.keys} == {("id",), ("account_id", "title"), ("body",)}  # body by its index; deferrable, partial and expression keys prove nothing
    assert p.allowed == {"kind": ("b",), "title": ("p", "q", "r")}
    with pytest.raises(SourceError):
        schema_from_sql("create table a (x int); create table a (y int)")


def test_statements_by_schema_alone(spark, tmp_path):
    s = schema_from_sql(BASE)
    s.register(spark, f"file://{tmp_path}")
    c = Statement(spark, "select id, display_name, status, role from accounts where email = :email", s).analyze()
    assert c.cardinality == "optional" and [x.null.kind for x in c.columns] == ["nonNull", "nullable", "nonNull", "nonNull"]
    assert c.columns[3].client_type == "Literal['member', 'admin']" and c.params[0].type == "string"
    insert = "-- @nullable display_name\ninsert into accounts (public_id, email, display_name, role) values (:public_id, :email, :display_name, :role)"
    c = Statement(spark, insert, s).analyze()
    assert {p.name: (p.nullable, p.admission, p.labels) for p in c.params} == {"public_id": (False, "rejects", None), "email": (False, "rejects", None), "display_name": (True, "accepts", None), "role": (False, "rejects", ("member", "admin"))}
    with pytest.raises(ContractError):
        Statement(spark, insert.replace("@nullable display_name", "@nullable role"), s).analyze()
