"""Session context. What Spark has no notion of is read from ``lakeloom.context.NAME`` in the session's configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeloom.functions.base import Any, Col, F

_CONFIGURED = "account account_name available_roles client ip_address organization_name organization_user region role role_type secondary_roles statement transaction warehouse".split()
__all__ = ["current_schemas", "current_session", "getvariable", "invoker_role", "is_role_in_session", "last_query_id", "last_transaction", "invoker_share", "is_application_role_in_session", "is_database_role_in_session", "is_granted_to_invoker_role", "system_reference", "all_user_names", *(f"current_{n}" for n in _CONFIGURED)]


def _setting(name: str) -> Col:
    session = SparkSession.getActiveSession()
    value = session.conf.get(f"lakeloom.context.{name}", None) if session else None
    return Col(F.lit(value).cast("string"))


for _name in _CONFIGURED:
    globals()[f"current_{_name}"] = lambda _n=_name: _setting(_n)


def current_schemas() -> Col:
    return Col(F.array(*[F.lit(d.name) for d in SparkSession.getActiveSession().catalog.listDatabases()]))


def current_session() -> Col:
    return Col(F.lit(SparkSession.getActiveSession().sparkContext.applicationId))


def getvariable(name: str) -> Col:
    return _setting(f"variable.{name}")


def invoker_role() -> Col:
    return _setting("role")


def is_role_in_session(role: Any) -> Col:
    return Col(_setting("role").c.eqNullSafe(F.lit(role) if isinstance(role, str) else role))


is_application_role_in_session = is_database_role_in_session = is_granted_to_invoker_role = is_role_in_session


def invoker_share() -> Col:
    return _setting("share")


def last_transaction() -> Col:
    return _setting("last_transaction")


def system_reference(kind: str, name: str) -> Col:
    """A reference to an object, as text."""
    return Col(F.lit(f"{kind.upper()}:{name}"))


def last_query_id() -> Col:
    return _setting("last_query_id")


def all_user_names() -> Col:
    return Col(F.array(F.current_user()))
