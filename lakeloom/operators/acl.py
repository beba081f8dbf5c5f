"""Access control: entries to reader tokens, tokens to filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import is_blank

EVERYONE, EVERYONE_GROUP = "__Everyone__", "GROUP_EVERYONE"
# What counts as reading.
READ_ROLES = ("Consumer", "Contributor", "Collaborator", "Coordinator", "Manager")
READ_PERMISSIONS = ("Read", "ReadVersion", "ReadWrite", "Everything")


@dataclass(frozen=True)
class Principal:
    """Who asks, in one source; an administrator there sees all of it."""

    source_id: str
    user: str | None = None
    groups: tuple[str, ...] = ()
    admin: bool = False


@dataclass(frozen=True)
class Asker:
    """The identities of one person in several sources."""

    identities: tuple[Principal, ...] = field(default_factory=tuple)

    def tokens(self) -> list[str]:
        """Tokens accepted; a source without a user name counts for nothing. Everyone's group is always among the groups."""
        out = [EVERYONE]
        for p in self.identities:
            if p.user is not None:
                groups = [EVERYONE_GROUP, *[g if g.startswith("GROUP_") else "GROUP_" + g for g in p.groups]]
                out += [f"u:{p.user}_#_{p.source_id}", *[f"g:{g}_#_{p.source_id}" for g in groups]]
        return list(dict.fromkeys(out))


def asker_tokens(askers: DataFrame, memberships: DataFrame) -> DataFrame:
    """askers (q, user, source_id) with `tokens`: the user's and those of the groups it is in there.

    memberships: user, source_id, group. Everyone's group comes first and is there for askers without any
    membership, as where the lookup failed; a null user has no tokens but everyone's. One row a q.
    """
    group = F.when(F.startswith("group", F.lit("GROUP_")), F.col("group")).otherwise(F.concat(F.lit("GROUP_"), F.col("group")))
    known = memberships.where(~is_blank(F.col("group"))).groupBy("user", "source_id").agg(F.array_sort(F.collect_set(group)).alias("groups"))
    joined = askers.join(known, ["user", "source_id"], "left")
    own = F.concat(F.array(F.concat(F.lit("u:"), F.col("user"))), F.transform(F.array_distinct(F.concat(F.array(F.lit(EVERYONE_GROUP)), F.coalesce("groups", F.array().cast("array<string>")))), lambda g: F.concat(F.lit("g:"), g)))
    tokens = F.when(F.col("user").isNotNull(), F.transform(own, lambda t: F.concat(t, F.lit("_#_"), F.col("source_id")))).otherwise(F.array().cast("array<string>"))
    each = joined.select("q", tokens.alias("own")).groupBy("q").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own"))
    return each.select("q", F.concat(F.array(F.lit(EVERYONE)), "own").alias("tokens"))


def permitted(racl: Column, source_id: Column, asker: Asker) -> Column:
    """Whether any token fits or the asker administers the source; nothing where no identity has a user."""
    known = [p for p in asker.identities if p.user is not None]
    if not known:
        return F.lit(False)
    out = F.arrays_overlap(racl, F.array(*[F.lit(t) for t in asker.tokens()]))
    admins = [p.source_id for p in known if p.admin]
    return out | source_id.isin(*admins) if admins else out


def clean_principals(names: Column) -> Column:
    """Trimmed, sorted, without nulls and blanks."""
    return F.array_sort(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "")))


def reader_tokens(readers: Column, source_id: Column) -> Column:
    """Stored names to tokens as queries use them."""

    def token(n: Column) -> Column:
        return F.when(n == EVERYONE_GROUP, F.lit(EVERYONE)).otherwise(F.concat(F.when(F.startswith(n, F.lit("GROUP_")), F.lit("g:")).otherwise(F.lit("u:")), n, F.lit("_#_"), source_id))

    return F.transform(clean_principals(readers), token)


def entries(readers: Column, source_id: Column) -> Column:
    """Access-control entries of a document: granted Read for a user or a group."""

    def entry(n: Column) -> Column:
        everyone, group = n == EVERYONE_GROUP, F.startswith(n, F.lit("GROUP_"))
        name = F.concat(n, F.lit("_#_"), source_id)
        return F.struct(F.lit(True).alias("granted"), F.lit("Read").alias("permission"), F.when(everyone, EVERYONE).when(~group, name).alias("user"), F.when(~everyone & group, name).alias("group"))

    return F.transform(clean_principals(readers), entry)


def normal_principal(name: Column, is_group: Column) -> Column:
    """Blank to null, Everyone to its group, known groups prefixed."""
    bare = F.trim(name)
    return F.when(bare == "Everyone", EVERYONE_GROUP).when(bare == "", None).when(is_group & ~F.startswith(bare, F.lit("GROUP_")), F.concat(F.lit("GROUP_"), bare)).otherwise(bare)


def first_match_readers(aces: DataFrame) -> DataFrame:
    """node_id, principal, granted: the first effective read entry that names the principal, or everyone, decides.

    aces: node_id, pos, principal, permission, granted, status. One shuffle by node and principal:
    everyone's first entry is a minimum over the node, joined back.
    """
    effective = aces.where((is_blank(F.col("status")) | (F.lower("status") == "effective")) & F.col("permission").isin(*READ_PERMISSIONS))
    own = effective.groupBy("node_id", "principal").agg(F.min(F.struct("pos", "granted")).alias("own"))
    all_ = effective.where(F.col("principal") == EVERYONE_GROUP).groupBy("node_id").agg(F.min(F.struct("pos", "granted")).alias("everyone"))
    return own.join(all_, "node_id", "left").select("node_id", "principal", F.least("own", "everyone")["granted"].alias("granted"))


def readers(candidates: DataFrame, aces: DataFrame) -> DataFrame:
    """node_id and readers (sorted): the candidates (node_id, principal) whom the first entry that names them doesn't deny.

    Those that no entry names are no readers.
    """
    verdicts = first_match_readers(aces)
    joined = candidates.distinct().join(verdicts, ["node_id", "principal"], "left")
    return joined.groupBy("node_id").agg(F.array_sort(F.collect_set(F.when(F.col("granted"), F.col("principal")))).alias("readers"))


def role_reads(role: Column) -> Column:
    names = [r for n in READ_ROLES for r in (n, "Site" + n)] + ["ReadPermissions", "Read"]
    return F.coalesce(role.isin(*names), F.lit(False))


def inherited_readers(permissions: DataFrame) -> DataFrame:
    """node_id and readers (sorted): allowed reading roles; inherited ones unless inheritance is explicitly off."""
    counts = (F.col("access_status") == "ALLOWED") & role_reads(F.col("role")) & (~F.col("inherited") | F.coalesce("inheritance_enabled", F.lit(True)))
    return permissions.groupBy("node_id").agg(F.array_sort(F.collect_set(F.when(counts, F.col("authority")))).alias("readers"))
