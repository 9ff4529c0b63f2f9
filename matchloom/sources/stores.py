"""Object-store access: settings only, paths stay plain URIs."""

from __future__ import annotations

# Spark settings by option; the values are given by whoever submits the job.
S3A_OPTIONS = {
    "endpoint": "spark.hadoop.fs.s3a.endpoint",
    "access_key": "spark.hadoop.fs.s3a.access.key",
    "secret_key": "spark.hadoop.fs.s3a.secret.key",
    "path_style": "spark.hadoop.fs.s3a.path.style.access",
    "credentials_provider": "spark.hadoop.fs.s3a.aws.credentials.provider",
}


def s3a_conf(**options: str | bool) -> dict[str, str]:
    """Settings for ``SparkSession.builder.config`` or ``spark-submit --conf``."""
    unknown = set(options) - set(S3A_OPTIONS)
    if unknown:
        raise ValueError(f"unknown object store option: {sorted(unknown)}")
    conf = {"spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}
    for name, value in options.items():
        conf[S3A_OPTIONS[name]] = str(value).lower() if isinstance(value, bool) else value
    return conf
