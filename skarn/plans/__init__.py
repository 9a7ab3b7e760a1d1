"""Plans that stay in the JVM: Catalyst expressions for single paths, a node table for many."""
