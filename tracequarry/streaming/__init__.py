"""The same results kept up to date as trace files arrive."""
