"""tidewire.sources"""
