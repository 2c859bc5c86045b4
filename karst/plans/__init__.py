"""Plans that several operators share: fixpoints over relations."""
