"""DataFrame to DataFrame operators over long-form series."""
