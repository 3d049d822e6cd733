"""Hashes and Ed25519 signatures of stories; keys and signatures are the JVM's (java.security)."""

from __future__ import annotations

import base64
import hashlib
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.display import canonical_json
from ..session import checkpoint
from ..sources.delimited import Table

VERSION, ALGORITHM = 1, "ed25519"
#: Where a signer's private key (base64 of PKCS 8) and public key (base64 of SPKI) may be given, and further trusted public
#: keys (separated by commas).
KEY_VARIABLE, PUBLIC_VARIABLE, TRUSTED_VARIABLE, KEY_FILE = "FACTLOOM_SIGNING_KEY", "FACTLOOM_PUBLIC_KEY", "FACTLOOM_TRUSTED_KEYS", "signing-key.b64"
#: Digests that a node of a table's hash tree stands for, about.
BRANCHES = 4096
_SIGNED = ("version", "engine", "algorithm", "csvSha256", "factsSha256", "storySha256", "publicKey")


def sha256(data: str) -> str:
    return hashlib.sha256(data.encode("utf-8", "replace")).hexdigest()


@dataclass
class Signer:
    """A key pair; both keys in base64 (PKCS 8 and SPKI)."""

    spark: SparkSession
    private_key: str
    public_key: str

    def sign(self, data: bytes) -> str:
        jvm = self.spark._jvm
        spec = jvm.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(self.private_key))
        signature = jvm.java.security.Signature.getInstance("Ed25519")
        signature.initSign(jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(spec))
        signature.update(data)
        return base64.b64encode(bytes(signature.sign())).decode()


def new_signer(spark: SparkSession) -> Signer:
    jvm = spark._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = jvm.java.security.KeyFactory.getInstance("Ed25519")
    of = lambda key, kind: base64.b64encode(bytes(factory.getKeySpec(key, spark._jvm.java.lang.Class.forName(kind)).getEncoded())).decode()
    return Signer(
        spark,
        of(pair.getPrivate(), "java.security.spec.PKCS8EncodedKeySpec"),
        of(pair.getPublic(), "java.security.spec.X509EncodedKeySpec"),
    )


def signer_of(spark: SparkSession, private_key: str, public_key: str) -> Signer:
    """The signer of two keys, which have to belong together."""
    made = Signer(spark, private_key, public_key)
    try:
        fits = signature_holds(spark, public_key, b"probe", made.sign(b"probe"))
    except Exception as e:
        raise ValueError("the private key can't be read: it has to be Ed25519 in PKCS 8, in base64") from e
    if not fits:
        raise ValueError("the public key isn't that of the private key")
    return made


def load_signer(spark: SparkSession, folder: str | os.PathLike) -> Signer:
    """The signer of KEY_VARIABLE and PUBLIC_VARIABLE, else the one kept in a folder of the driver, else a new one that
    is kept there: the private key and the public key, each on a line.

    A signer that is kept goes on being trusted after a restart.
    """
    given = [os.environ.get(v, "").strip() for v in (KEY_VARIABLE, PUBLIC_VARIABLE)]
    path = Path(folder) / KEY_FILE
    if not given[0] and path.exists():
        given = path.read_text().split()
    if given[0]:
        if len(given) != 2 or not given[1]:
            raise ValueError("a private key comes with its public key")
        return signer_of(spark, *given)
    made = new_signer(spark)
    path.parent.mkdir(parents=True, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as file:
        file.write(f"{made.private_key}\n{made.public_key}\n")
    return made


def trusted_keys(own: str) -> set[str]:
    """The own public key and those of TRUSTED_VARIABLE."""
    return {own} | {k.strip() for k in os.environ.get(TRUSTED_VARIABLE, "").split(",") if k.strip()}


# ---- digests --------------------------------------------------------------------------


def table_digest(table: Table) -> str:
    """SHA-256 of a hash tree over a table's distinct rows, with row ids and counts; whatever the partitions.

    Rows are hashed where they lie; a node hashes the digests of its branches in their order.
    """
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null")) for c in ("row_id", *table.kinds)]
    row = F.sha2(F.to_json(F.array(*cells)), 256)
    level = table.df.select(row.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    level = checkpoint(level.select(F.concat_ws(":", "d", "n").alias("d")))
    n = level.count()
    while n > BRANCHES:
        # equal hashes are one row by now, so the beginnings of digests deal them out evenly
        nodes = -(-n // BRANCHES)
        level = level.groupBy(F.pmod(F.conv(F.substring("d", 1, 12), 16, 10).cast("long"), F.lit(nodes)).alias("node"))
        level = checkpoint(level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d")).select("d"))
        n = level.count()
    kinds = canonical_json(list(table.kinds.items()))
    return "rows:" + sha256(kinds + ",".join(sorted(r["d"] for r in level.collect())))  # at most BRANCHES rows


def digest_of(source: str | Table) -> str:
    return sha256(source) if isinstance(source, str) else table_digest(source)


def signature_holds(spark: SparkSession, public_key: str, data: bytes, signature: str) -> bool:
    jvm = spark._jvm
    try:
        spec = jvm.java.security.spec.X509EncodedKeySpec(base64.b64decode(public_key))
        check = jvm.java.security.Signature.getInstance("Ed25519")
        check.initVerify(jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(spec))
        check.update(data)
        return bool(check.verify(base64.b64decode(signature)))
    except Exception:  # a key or signature that can't even be read
        return False


def _signed(bundle: dict) -> bytes:
    return canonical_json({k: bundle[k] for k in _SIGNED}).encode()


def _without_proof(story: dict) -> dict:
    return {k: v for k, v in story.items() if k != "proof"}


def sign(source: str | Table, story: dict, signer: Signer, engine: str) -> dict:
    """The proof of a story and its source."""
    bundle = {
        "version": VERSION,
        "engine": engine,
        "algorithm": ALGORITHM,
        "csvSha256": digest_of(source),
        "factsSha256": sha256(canonical_json(story["facts"])),
        "storySha256": sha256(canonical_json(_without_proof(story))),
        "publicKey": signer.public_key,
    }
    return bundle | {"signature": signer.sign(_signed(bundle))}


def objection(spark: SparkSession, story: dict, trusted: set[str]) -> str | None:
    """Why a story's proof doesn't hold."""
    bundle = story.get("proof")
    if not bundle:
        return "there is no proof"
    if not isinstance(bundle, dict) or not all(isinstance(bundle.get(k), str) for k in (*_SIGNED[1:], "signature")):
        return "the proof is incomplete"
    if bundle.get("publicKey") not in trusted:
        return "the key is not trusted"
    if sha256(canonical_json(_without_proof(story))) != bundle["storySha256"]:
        return "the story was changed after it was signed"
    if sha256(canonical_json(story.get("facts"))) != bundle["factsSha256"]:
        return "the facts were changed after they were signed"
    if "version" not in bundle or not signature_holds(spark, bundle["publicKey"], _signed(bundle), bundle["signature"]):
        return "the signature doesn't fit"
    return None
